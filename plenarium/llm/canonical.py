"""One consistent form for text that looks alike (problem 2).

Method: a text is scanned for *unstable* characters only, those whose normalization quick check is not "yes" (they
compose, or decompose to a plain form), and those that are invisible, a special space or a special hyphen. A maximal
run of them together with the one character before it (the starter that an accent may join) is a segment; segments
alone are normalized and spliced back between the untouched stretches. Afterwards every word with letters of several
scripts is written in the one script that most of its letters have.

The classes of characters come from the Unicode data of the interpreter by the rules in ``_tables``; only the
look-alike letters are listed. A letter that is listed is no compatibility form: the word decides what it stands for.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of Cyrillic and Greek that look like the Latin letter in the same place.
CYRILLIC, CYRILLIC_AS_LATIN = "АВЕІЈКМНОРСЅТУХԚԜаеіјорсѕухһԁԛԝѵӏк", "ABEIJKMHOPCSTYXQWaeijopcsyxhdqwvlk"
GREEK, GREEK_AS_LATIN = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονακιρυχϲϳ", "ABEZHIKMNOPTYXovakipuxcj"
# Hyphens written with a character of their own.
HYPHENS = "‐‑﹣－"

SCRIPTS = ("Latin", "Cyrillic", "Greek")
PLAIN = "[^ -~]"  # a text without a match is in the consistent form

_WORD = regex.compile(r"[\p{L}\p{M}]+")
_SCRIPT = {s: regex.compile(rf"\p{{Script={s}}}") for s in SCRIPTS}


@lru_cache(maxsize=1)
def _tables() -> tuple[regex.Pattern, dict[int, str]]:
    """The pattern of a segment, and the replacement of each character that has one."""
    replace: dict[int, str] = {}
    unstable: list[int] = []
    accented: list[tuple[int, str]] = []
    for code in range(0x80, 0x2FA20):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Cs", "Co"):
            continue
        form = unicodedata.decomposition(c)
        if kind == "Zs" or c in "\u0085  ":
            replace[code] = " "
        elif kind == "Cf" or c in "͏ᅟᅠ឴឵ㅤﾠ" or 0xFE00 <= code <= 0xFE0F or 0x180B <= code <= 0x180F:
            replace[code] = ""
        elif c in HYPHENS:
            replace[code] = "-"
        elif form.startswith(("<wide>", "<narrow>", "<font>", "<noBreak>")) or form.startswith("<compat>") and kind[0] == "L" and c not in GREEK:
            replace[code] = unicodedata.normalize("NFKC", c)
        if code in replace or unicodedata.combining(c) or not unicodedata.is_normalized("NFC", c) or 0x1161 <= code <= 0x11FF:
            unstable.append(code)
        # quick check "maybe": the later part of a composition may join what stands before it, even if it is no accent
        if form and form[0] != "<" and " " in form and unicodedata.normalize("NFC", unicodedata.normalize("NFD", c)) == c:
            unstable.append(int(form.split()[-1], 16))
        parts = unicodedata.normalize("NFD", c)
        if code not in replace and len(parts) > 1 and any(ord(x) in replace for x in parts):  # an accented form of such a character
            accented.append((code, parts))
    for code, parts in accented:
        replace[code] = parts.translate(replace)
        unstable.append(code)
    for code in (*range(0x20), *range(0x7F, 0xA0)):
        replace[code] = " " if chr(code) in "\t\n\v\f\r\x85" else ""
        unstable.append(code)
    for code in (*range(0xE0000, 0xE0080), *range(0xE0100, 0xE01F0)):
        replace[code] = ""
        unstable.append(code)
    ranges: list[list[int]] = []
    for code in sorted(set(unstable)):
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    members = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)
    return regex.compile(f"[^{members}]?[{members}]+"), replace


@lru_cache(maxsize=1)
def _look_alikes() -> dict[str, dict[str, str]]:
    """For each script: letters of the others and the letter of it that looks the same."""
    to: dict[str, dict[str, str]] = {s: {} for s in SCRIPTS}
    for other, letters, latin in (("Cyrillic", CYRILLIC, CYRILLIC_AS_LATIN), ("Greek", GREEK, GREEK_AS_LATIN)):
        for a, b in zip(letters, latin, strict=True):
            to["Latin"][a] = b
            to[other].setdefault(b, a)
    for other, back in (("Cyrillic", "Greek"), ("Greek", "Cyrillic")):
        for a, latin in list(to["Latin"].items()):
            if _SCRIPT[back].match(a) and latin in to[other]:
                to[other].setdefault(a, to[other][latin])
    return to


def _one_script(word: str) -> str:
    """``word`` in the script of most of its letters, of those scripts in which all of it can be written."""
    parts = unicodedata.normalize("NFD", word)
    count = {s: len(_SCRIPT[s].findall(parts)) for s in SCRIPTS}
    present = sorted((s for s in SCRIPTS if count[s]), key=lambda s: (-count[s], SCRIPTS.index(s)))
    if len(present) < 2:
        return word
    for script in present:
        table = _look_alikes()[script]
        out = []
        for c in parts:
            if any(_SCRIPT[s].match(c) for s in present if s != script):
                if c not in table:
                    break
                c = table[c]
            out.append(c)
        else:
            return unicodedata.normalize("NFC", "".join(out))
    return word


def canonical_text(text: str) -> str:
    """The consistent form of ``text``: composed accents, plain half-width characters, ordinary spaces and hyphens,
    nothing invisible, every word in one script. Spelling, case, other punctuation and the number of spaces stay."""
    if text.isascii() and text.isprintable():
        return text
    segment, replace = _tables()
    text = segment.sub(lambda m: unicodedata.normalize("NFC", m[0].translate(replace)), text)
    return text if text.isascii() else _WORD.sub(lambda m: _one_script(m[0]), text)


def canonical_array(values: pa.Array | pa.ChunkedArray) -> pa.Array:
    """``canonical_text`` over an Arrow array, once for every different value; nulls stay null."""
    coded = pc.dictionary_encode(values)
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    forms = pa.array([canonical_text(x) for x in coded.dictionary.to_pylist()], pa.string())
    return forms.take(coded.indices)


def canonical_changes(df: DataFrame, key: str, column: str, result: str) -> DataFrame:
    """``key`` and ``result`` of the rows whose ``column`` is not in the consistent form.

    Narrow: no shuffle, so a value that holds a third of all rows costs no more than others. Plain ASCII rows end in
    the JVM and are never sent to Python. Null, empty: no rows. Repeated rows: a row each. Names wholly in another
    script are in the form already.
    """
    kind = dict(df.dtypes)[key]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            form = canonical_array(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), form], [key, result]).filter(pc.not_equal(b.column(1), form))

    rows = df.select(F.col(key), F.col(column)).where(F.col(column).rlike(PLAIN))
    return rows.mapInArrow(work, f"`{key}` {kind}, `{result}` string")
