import math
import random
from collections import Counter, defaultdict

from plenarium.operators import heavy_keys as hk


def table(spark, rows):
    return spark.createDataFrame(rows, "k string, v long, key string, value long, weight long")


def make(n=4000, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(["hot"] * 6 + ["a", "b", "c", None]), rng.choice([None, *[int(rng.gauss(0, 50)) for _ in range(9)]]), "clash", 1, 1) for _ in range(n)]


def test_profile_and_percentiles_match_brute_force(spark):
    rows = make()
    w = hk.compress(table(spark, rows), "k", "v")
    by = defaultdict(list)
    for k, v, *_ in rows:
        by[k].append(v)
    got = {r["key"]: r for r in hk.key_profile(w).collect()}
    assert set(got) == set(by)
    for k, vs in by.items():
        there = [v for v in vs if v is not None]
        mode = min(Counter(there).items(), key=lambda x: (-x[1], x[0]))
        assert (got[k]["n_rows"], got[k]["n_values"], got[k]["mode_value"], got[k]["mode_rows"]) == (len(vs), len(set(there)), *mode)
    for share in (0.1, 0.5, 0.9, 1.0):
        p = {r["key"]: r["percentile_value"] for r in hk.key_percentile(w, share).collect()}
        for k, vs in by.items():
            there = sorted(v for v in vs if v is not None)
            assert p[k] == there[math.ceil(len(there) * share) - 1], (k, share)


def test_heavy(spark):
    rows = [("hot", 1, "", 1, 1)] * 40 + [(f"k{i}", 1, "", 1, 1) for i in range(57)] + [("edge", 1, "", 1, 1)] * 3 + [(None, 1, "", 1, 1)] * 0
    got = {r["key"]: r["n_rows"] for r in hk.heavy_keys(hk.compress(table(spark, rows), "k", "v"), 0.03).collect()}
    assert got == {"hot": 40, "edge": 3}


def test_null_keys_count_in_the_total(spark):
    rows = [(None, 1, "", 1, 1)] * 98 + [("a", None, "", 1, 1)] * 2
    assert hk.heavy_keys(hk.compress(table(spark, rows), "k", "v")).count() == 0
    profile = {r["key"]: r for r in hk.key_profile(hk.compress(table(spark, rows), "k", "v")).collect()}
    assert profile["a"]["n_values"] == 0 and profile["a"]["mode_value"] is None and profile["a"]["mode_rows"] is None


def test_empty(spark):
    w = hk.compress(table(spark, []), "k", "v")
    assert hk.heavy_keys(w).count() == hk.key_profile(w).count() == hk.key_percentile(w, 0.5).count() == 0


def test_long_values(spark):
    df = spark.createDataFrame([("x" * 100_000, "y" * 100_000)] * 3, "k string, v string")
    assert hk.key_profile(hk.compress(df, "k", "v")).first()["mode_rows"] == 3
