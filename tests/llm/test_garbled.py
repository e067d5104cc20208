import pytest
from plenarium.llm import garbled
from plenarium.llm.garbled import repair_encoding


def repair_text(text):
    return garbled.repair_text(text)[:2]


FRENCH = "Le préfet a déjà rejeté la réforme du séjour à Ömistad… ça coûte 30 €"
UKRAINIAN = "Шановні колеги, міська рада зареєструвала угоду"
POLISH = "Państwo, sąd najwyższy wciąż żąda"


@pytest.mark.parametrize("codec", ["cp1252", "cp437", "cp850", "mac_roman"])
def test_round_trips_of_multibyte_text(codec):
    for text in (FRENCH.replace("à", "è"), "Größe für Übrigens – “ja”"):
        raw = text.encode()
        bad = "".join(bytes([b]).decode(codec) if codec != "cp1252" or b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in raw)
        assert repair_text(bad) == (True, text), codec
        assert repair_text(f"Clean before. {bad}") == (True, f"Clean before. {text}")


def test_other_code_pages():
    assert repair_text(UKRAINIAN.encode().decode("cp1251")) == (True, UKRAINIAN)
    assert repair_text(UKRAINIAN.encode().decode("latin1")) == (True, UKRAINIAN)
    assert repair_text(POLISH.encode().decode("cp1250")) == (True, POLISH)


def test_garbled_twice():
    once = FRENCH.encode().decode("latin1")
    assert repair_text(once.encode().decode("latin1")) == (True, FRENCH)


WORDS = "según la oposición del técnico el préstamo está así für größere Plätze über Städte être déjà où çà naïf señor año – “oui”".split()
UK = "прикордонна служба чекає на рішення міської ради про угоду і біженців".split()


def corpus(n, words, seed):
    import random

    rng = random.Random(seed)
    return [" ".join(rng.choice(words) for _ in range(12)) for _ in range(n)]


def repaired(spark, clean, other):
    """What the operator says of ``other`` texts in a corpus of ``clean`` ones."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*clean, *other])], "id long, text string").repartition(3)
    found = {r["id"]: (r["restored"], r["whole"]) for r in repair_encoding(df, "id", "text").collect()}
    assert all(i >= len(clean) for i in found), [clean[i] for i in found if i < len(clean)]
    return [found.get(len(clean) + i) for i in range(len(other))]


@pytest.mark.parametrize("written,read", [("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850")])
def test_single_byte_mistakes(spark, written, read):
    """Texts that the corpus does not hold, made of its words: all are found and restored."""
    texts = [t for t in corpus(8, WORDS, 7) if not t.isascii()]
    bad = [t.encode(written).decode(read) for t in texts]
    assert repaired(spark, corpus(900, WORDS, 1), bad) == [(t, True) for t in texts]


def test_cyrillic_as_latin(spark):
    texts = corpus(5, UK, 3)
    bad = [t.encode("cp1251").decode("cp1252") for t in texts]
    assert repaired(spark, corpus(900, UK, 1) + corpus(200, WORDS, 1), bad) == [(t, True) for t in texts]


def test_letters_lost_to_question_marks(spark):
    lost = [t.encode("ascii", "replace").decode() for t in corpus(4, WORDS, 5)]
    other = ["Really? Yes. Is it so?No", "see page?id=1", "what??", "?", "12?a"]
    assert repaired(spark, corpus(900, WORDS, 1), lost + other) == [(None, False)] * len(lost) + [None] * len(other)


def test_rare_is_not_mistaken(spark):
    other = ["xΩy", "ÀÉÈÊ", "Ångström Łódź Dvořák", "5 ± 2 °C, ½, m²", "Paral·lel col·legi", "³He and ¿qué?"]
    assert repaired(spark, corpus(900, WORDS, 1), other) == [None] * len(other)


def test_lost():
    assert repair_text("Mir�r Jor�roua") == (True, None)
    assert repair_text("a\x93b")[0]


CLEAN = [FRENCH, UKRAINIAN, POLISH, "Рішення Ради, Рік. С… «Січень»", "Ãroavy, NÃO, Ömiør, Łobãroua", "├── src\n│   └── a.txt", "d'été – l’âge, l’école… « né »", "5 ± 2 °C, ½, m², № 5, a·b", "Paral·lel col·legi", "中文 移民 日本語 👩‍👧", "Ελλάδα και Κύπρος", "né »", "ÃROWESÚL", "Ívaívaés İstanbul", ""]


@pytest.mark.parametrize("text", CLEAN)
def test_clean(text):
    assert repair_text(text) == (False, None)


def test_rows(spark):
    rows = [(1, "dÃ©jÃ  vu", "x"), (2, None, "x"), (3, "", "x"), (4, "plain", "x"), (5, "été", "x"), (6, "a�", "x"), (1, "dÃ©bat", "x"), (7, "clean " * 50_000 + "dÃ©bat", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, restored string")
    got = sorted((r["doc_id"], r["whole"]) for r in repair_encoding(df, "doc_id", "text").collect())
    assert got == [(1, True), (1, True), (6, False), (7, True)]
    assert repair_encoding(df.limit(0), "doc_id", "text").count() == 0
