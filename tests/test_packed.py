import pytest
from plenarium.operators import packed

SCHEMA = "record_table string, record_id long, field string, text string, items string, pos string"


def rows(spark, texts, field="actors"):
    return spark.createDataFrame([("t", i, field, x, "clash", "clash") for i, x in enumerate(texts)], SCHEMA)


def found(spark, texts, field="actors"):
    out = {}
    for r in packed.unpack(rows(spark, texts, field), [field]).orderBy("record_id", "pos").collect():
        out.setdefault(r["record_id"], []).append(r["item"])
        assert r["pos"] == len(out[r["record_id"]])
    return out


# lists by syntax tell that commas and ' / ' may be parts of items
KNOWN = ['["Ministry of Labour, Family and Youth", "Coast Guard"]', '["Regional Court", "Coast Guard", "Foreign Ministry"]', '["Relief Fund", "Coast Guard"]', '["Coast Guard", "Regional Court"]', '["Coast Guard"]']

CASES = [
    ("Coast Guard; Regional Court", ["Coast Guard", "Regional Court"]),
    ("Coast Guard；Regional Court", ["Coast Guard", "Regional Court"]),
    ("A, B and C | Coast Guard|D", ["A, B and C", "Coast Guard", "D"]),
    ("Coast Guard || Regional Court || ", ["Coast Guard", "Regional Court"]),
    ("Coast Guard, Regional Court", ["Coast Guard", "Regional Court"]),
    ('"Relief Fund; coastal branch", Coast Guard', ["Relief Fund; coastal branch", "Coast Guard"]),
    ('"Coalition ""Open Shore"""', ['Coalition "Open Shore"']),
    ('Coalition "Open Shore"; Coast Guard', ['Coalition "Open Shore"', "Coast Guard"]),
    ("['Coast Guard', 'Coalition \"Open Shore\"']", ["Coast Guard", 'Coalition "Open Shore"']),
    ("['it\\'s', \"a\"]", ["it's", "a"]),
    ("“Coast Guard”, “Regional Court”", ["Coast Guard", "Regional Court"]),
    ("· Coast Guard · Regional Court", ["Coast Guard", "Regional Court"]),
    ("• Coast Guard\n• Regional Court", ["Coast Guard", "Regional Court"]),
    ("Coast Guard\r\nRegional Court", ["Coast Guard", "Regional Court"]),
    ("Coast Guard\tCoast Guard", ["Coast Guard", "Coast Guard"]),
    (" Coast Guard ", ["Coast Guard"]),
    ("; ;Coast Guard; ", ["Coast Guard"]),
    ("|Coast Guard|Regional Court", ["Coast Guard", "Regional Court"]),
    (';"Relief Fund; coastal branch"; Coast Guard', ["Relief Fund; coastal branch", "Coast Guard"]),
]


def test_forms(spark):
    got = found(spark, KNOWN + [c[0] for c in CASES])
    for i, (text, items) in enumerate(CASES):
        assert got[len(KNOWN) + i] == items, text


def test_slash_is_part_of_pairs_only(spark):
    pairs = ['["a / b", "c / d"]', "a / b; c / d", "a / b, c / d", "a / b"]
    assert found(spark, pairs, "focus") == {0: ["a / b", "c / d"], 1: ["a / b", "c / d"], 2: ["a / b", "c / d"], 3: ["a / b"]}
    assert found(spark, [*KNOWN, "Sweden / Norway"])[len(KNOWN)] == ["Sweden", "Norway"]


def test_tables_have_dialects_of_their_own(spark):
    """A comma is part of items in one table, and a delimiter in the other; both call the field the same."""
    names = [f'["Council {i}, North", "Court {i}, South"]' for i in range(40)]
    plain = [f'["Guard {i}", "Court {i}"]' for i in range(40)]
    rows = [(t, i, "f", x) for t, texts in (("a", [*names, "Council 1, North"]), ("b", [*plain, "Guard 1, Court 2"])) for i, x in enumerate(texts)]
    df = spark.createDataFrame([(*r, "") for r in rows], "record_table string, record_id long, field string, text string, pos string")
    comma, found = packed.CANDIDATES["comma"], packed.infer_dialects(df)
    assert comma not in found["a", "f"].always + found["a", "f"].alone and comma in found["b", "f"].alone


def test_numbers_of_pieces_count(spark):
    """A sign that cuts items into many more pieces than lists have scores less."""
    assert packed._overlap({2: 10}, {2: 5}) == 1 and packed._overlap({2: 10}, {9: 5}) == 0 and packed._overlap({}, {1: 1}) == 0
    assert packed._overlap({2: 5, 3: 5}, {3: 4, 4: 4}) == 0.5


def test_null_blank_and_empty(spark):
    assert found(spark, [None, "", "  \n ", ";"]) == {}
    assert packed.unpack(rows(spark, []), ["actors"]).count() == 0
    assert [f.name for f in packed.unpack(rows(spark, []), ["actors"]).schema] == ["record_table", "record_id", "field", "pos", "item"]


def test_null_key_and_repeats(spark):
    df = spark.createDataFrame([(None, None, "actors", "a; b"), ("t", 1, "actors", "a; b"), ("t", 1, "actors", "a; b"), ("t", 2, None, "x; y")], "record_table string, record_id long, field string, text string")
    assert packed.unpack(df, ["actors"]).count() == 6


def test_very_long(spark):
    n = 20_000
    assert len(found(spark, ["; ".join(f"item {i}" for i in range(n))])[0]) == n


@pytest.mark.parametrize("name", ["p1_found"])
def test_query(spark, smallest, name):
    from plenarium.plans.problems import QUERIES

    df = QUERIES[name](spark, smallest)
    assert df.columns == ["record_table", "record_id", "field", "pos", "item"] and dict(df.dtypes)["pos"] == "int" and df.count() > 0
