import random
from collections import defaultdict

import pytest
from plenarium.llm import topn

SCHEMA = "country string, n long, attention_id long, group string, score long, id long, place int"


def brute(rows, n):
    by = defaultdict(list)
    for c, s, i, *_ in rows:
        if None not in (c, s, i):
            by[c].append((-s, i))
    return sorted((c, i, -s, p + 1) for c, xs in by.items() for p, (s, i) in enumerate(sorted(xs)[:n]))


@pytest.mark.parametrize("renew,hold", [(100_000, 400_000), (7, 5)])
def test_brute_force(spark, monkeypatch, renew, hold):
    monkeypatch.setattr(topn, "RENEW", renew)
    monkeypatch.setattr(topn, "HOLD", hold)
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 20 + ["a", "b", "c", None] + [f"k{i}" for i in range(30)]), rng.choice([None, *range(6)]), i, "x", 1, 1, 1) for i in range(3000)]
    got = topn.top_n(spark.createDataFrame(rows, SCHEMA).repartition(5), "country", "n", "attention_id", 10)
    assert got.columns == ["country", "attention_id", "n", "place"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 10)


def test_repeats_empty_and_few(spark):
    rows = [("a", 1, 5, "", 1, 1, 1)] * 3 + [("b", None, 1, "", 1, 1, 1), ("x" * 100_000, 2, 9, "", 1, 1, 1)]
    got = topn.top_n(spark.createDataFrame(rows, SCHEMA), "country", "n", "attention_id", 2).collect()
    assert sorted((r["country"][:1], r["place"]) for r in got) == [("a", 1), ("a", 2), ("x", 1)]
    assert topn.top_n(spark.createDataFrame([], SCHEMA), "country", "n", "attention_id", 2).count() == 0
    assert topn.top_n(spark.createDataFrame(rows, SCHEMA), "country", "n", "attention_id", 0).count() == 0
