import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plenarium.llm.canonical import canonical_changes, canonical_text

CASES = [
    ("Ｕｒｋａｉｎｅ", "Urkaine"),
    ("Castorés", "Castorés"),
    ("Eur‎opean Uniοn", "European Union"),
    ("Ge­r﻿many", "Germany"),
    ("non‑breaking‐hyphen", "non-breaking-hyphen"),
    ("𝐅𝐞𝐝𝐞𝐫𝐚𝐥 𝖱𝖾𝗉𝗎𝖻𝗅𝗂𝖼", "Federal Republic"),
    ("Ег".replace("г", "g") + "урt", "Egypt"),
    ("Укpaїнa", "Україна"),
    ("Ελλάδa", "Ελλάδα"),
    ("Wor＇s", "Wor's"),
    ("a\tb\nc", "a b c"),
    ("\u0995\u09c7\u09be", "\u0995\u09cb"),
    ("\u0b95\u0bc6\u0bbe", "\u0b95\u0bca"),
    ("\u1025\u102e", "\u1026"),
    ("\u1100\u1161\u11a8", "\uac01"),
    ("ϲat", "cat"),
]
SAME = ["Україна", "Κύπρος", "Северна Македонија", "Việt Nam", "Azərbaycan", "Zanbarés", "« Malta »", "a  b ", "x…", "Türkiye – Syria", ""]


@pytest.mark.parametrize("text,form", CASES)
def test_forms(text, form):
    assert canonical_text(text) == form


@pytest.mark.parametrize("text", SAME)
def test_kept(text):
    assert canonical_text(text) == text


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs", "Cn", "Co")), max_size=30))
def test_idempotent_composed_and_visible(text):
    form = canonical_text(text)
    assert canonical_text(form) == form
    assert unicodedata.is_normalized("NFC", form)
    assert not any(unicodedata.category(c) in ("Cf", "Cc") for c in form if ord(c) < 0xE0000)


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("abceоаесАΑοϲϳςµμ\u0301\u200d\u09c7\u09be\u0995\u1025\u102e\u1100\u1161\u11a8ﾞｶカ１- "), max_size=12))
def test_idempotent_where_letters_meet(text):
    form = canonical_text(text)
    assert canonical_text(form) == form
    assert unicodedata.is_normalized("NFC", form)


def test_every_composition_is_composed():
    for code in range(0x80, 0x2FA20):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and unicodedata.normalize("NFC", parts) == chr(code) and unicodedata.category(chr(code))[0] in "LM":
            assert canonical_text(parts) == canonical_text(chr(code)), hex(code)


def test_over_rows(spark):
    rows = [(1, "Ｕｋ", "x"), (2, None, "x"), (3, "", "x"), (4, "plain", "x"), (5, "Ｕｋ", "x"), (5, "Ｕｋ", "x"), (None, "é" + "é" * 50_000, "x")]
    df = spark.createDataFrame(rows, "fact_id long, entity string, entity_clean string")
    got = canonical_changes(df, "fact_id", "entity", "entity_clean").collect()
    assert sorted((r[0] or 0, len(r[1])) for r in got) == [(0, 50_001), (1, 2), (5, 2), (5, 2)]
    assert canonical_changes(df.limit(0), "fact_id", "entity", "entity_clean").count() == 0
