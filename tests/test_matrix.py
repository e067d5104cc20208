import numpy as np
import pytest
from plenarium.operators import matrix as X
from pyspark.sql import functions as F

# smoking by staff group: a published table whose two inertia shares are 87.76 % and 11.76 %
STAFF = {"SM": [4, 2, 3, 2], "JM": [4, 3, 7, 4], "SE": [25, 10, 12, 4], "JE": [18, 24, 33, 13], "SC": [10, 6, 7, 2]}


@pytest.fixture(scope="module")
def staff(spark):
    return spark.createDataFrame([(r, f"c{i}", n) for r, ns in STAFF.items() for i, n in enumerate(ns)], "r string, c string, n long")


def test_correspondence(staff):
    got = X.correspondence(staff, "r", "c").collect()
    assert got[0]["inertia1"] == pytest.approx(0.8776, abs=0.0015) and got[0]["inertia2"] == pytest.approx(0.1176, abs=0.0015)
    assert sum(r["mass"] for r in got if r["kind"] == "row") == pytest.approx(1) and len(got) == 9


def test_correspondence_of_little(spark, staff):
    assert X.correspondence(staff.limit(0), "r", "c").count() == 0
    assert X.correspondence(staff.where("r = 'SM'"), "r", "c").count() == 0


def test_residuals_and_shares(staff):
    cells = X.residuals(staff, "r", "c").collect()
    assert sum(r["expected"] for r in cells) == pytest.approx(sum(map(sum, STAFF.values())))
    assert all(r["s"] == pytest.approx(1) for r in X.shares(staff, "r", "c", "n").groupBy("r").agg(F.sum("share").alias("s")).collect())


def test_zscores_and_cosine(spark, staff):
    f = staff.select("r", F.col("c").alias("feature"), F.col("n").cast("double").alias("value"))
    z = X.zscores(f, "r", 100).collect()
    m = np.array([[next(x["z"] for x in z if (x["r"], x["feature"]) == (r, f"c{i}")) for i in range(4)] for r in STAFF])
    t = np.array(list(STAFF.values()), float)
    assert np.allclose(m, (t - t.mean(0)) / t.std(0)) and np.allclose(m.mean(0), 0)
    cos = {(r["a"], r["b"]): r["similarity"] for r in X.cosine(f, "r", "value").collect()}
    assert len(cos) == 10
    for (a, b), s in cos.items():
        x, y = np.array(STAFF[a]), np.array(STAFF[b])
        assert s == pytest.approx(x @ y / np.linalg.norm(x) / np.linalg.norm(y))
    flat = X.zscores(spark.createDataFrame([("a", "f", 2.0), ("b", "f", 2.0)], "r string, feature string, value double"), "r")
    assert [r["z"] for r in flat.collect()] == [0.0, 0.0]


def test_pagerank_of_a_star(spark):
    e = spark.createDataFrame([("s", "a", 3.0), ("s", "b", 1.0)], "source string, target string, weight double")
    got = {r["node"]: r["rank"] for r in X.pagerank(e, rounds=40, tolerance=1e-5).collect()}
    s = 1 / (3 + 0.85)
    assert got["s"] == pytest.approx(s, abs=1e-4) and got["a"] == pytest.approx(s + 0.85 * s * 0.75, abs=1e-4) and sum(got.values()) == pytest.approx(1)
    assert X.pagerank(e.limit(0)).count() == 0


def test_pagerank_against_numpy(spark):
    rng = np.random.default_rng(0)
    w = np.triu(rng.integers(0, 4, (6, 6)), 1)
    e = spark.createDataFrame([(str(i), str(j), float(w[i, j])) for i in range(6) for j in range(6) if w[i, j]], "source string, target string, weight double")
    nodes = sorted({x for r in e.collect() for x in r[:2]})
    a = np.array([[w[int(i), int(j)] for j in nodes] for i in nodes], float)
    out, r = a.sum(1), np.full(len(nodes), 1 / len(nodes))
    for _ in range(200):
        r = 0.15 / len(nodes) + 0.85 * (sum(r[i] * a[i] / out[i] for i in range(len(nodes)) if out[i]) + r[out == 0].sum() / len(nodes))
    got = {x["node"]: x["rank"] for x in X.pagerank(e, rounds=40, tolerance=1e-5).collect()}
    assert np.allclose([got[n] for n in nodes], r, atol=1e-3)
