import json

import pytest
from plenarium.operators import answers as N
from plenarium.sources import files as S
from plenarium.streaming import speeches as ST
from pyspark.sql import functions as F


@pytest.fixture()
def root(spark, smallest, tmp_path):
    facts = spark.read.parquet(f"{smallest}/facts.parquet").where("country in ('GBR', 'FRA')").withColumn("y", F.year("session_date"))
    for c in ("GBR", "FRA"):
        for y in (2015, 2016):
            facts.where(f"country = '{c}' and y = {y}").drop("y").write.parquet(S.fact_path(str(tmp_path), c, y))
    return str(tmp_path)


def test_fact_files(spark, root):
    assert len(S.discover(spark, root)) == 4 and len(S.discover(spark, root, "GBR", [2016])) == 1
    df = S.read_facts(spark, root, "GBR")
    assert {r[0] for r in df.select("source_year").distinct().collect()} <= {2015, 2016} and df.where("year(session_date) <> source_year").count() == 0
    with pytest.raises(FileNotFoundError, match="GBR_1999.*GBR_2000"):
        S.read_facts(spark, root, "GBR", [1999, 2000, 2015])
    with pytest.raises(FileNotFoundError):
        S.read_first(spark, f"{root}/x.parquet", f"{root}/y.parquet")
    first = S.read_first(spark, f"{root}/x.parquet", *S.discover(spark, root, "GBR", [2015]))
    assert first.count() == S.with_source(first).where("source_country = 'GBR'").count()


def test_unions_and_columns(spark):
    a = spark.createDataFrame([(1, "x")], "id int, v string")
    b = spark.createDataFrame([(2.5, 7, True)], "id double, v int, w boolean")
    got = S.union_relaxed([a, b])
    assert dict(got.dtypes) == {"id": "double", "v": "string", "w": "boolean"} and {tuple(r) for r in got.collect()} == {(1.0, "x", None), (2.5, "7", True)}
    assert S.first_column(a, ["z", "v"]) == "v" and S.first_column(a, ["z"], False) is None
    with pytest.raises(ValueError):
        S.first_column(a, ["z"])


def test_text_files(spark, tmp_path):
    (tmp_path / "words.tsv").write_text("Word\tConc.M\nBoat\t4.5\nidea\tnone\nboat\t4.9\n\t1\n")
    assert {tuple(r) for r in S.read_lexicon(spark, str(tmp_path / "words.tsv")).collect()} == {("boat", 4.9)}
    df = spark.createDataFrame([("a", [1, 2], {"k": 1})], "x string, y array<int>, z map<string,int>")
    S.write_table(df, str(tmp_path / "out.csv"), "csv")
    row = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out.csv")).first()
    assert json.loads(row["y"]) == [1, 2]
    with pytest.raises(ValueError):
        S.read_any(spark, "x.xlsx")
    doc = json.loads(S.nested_json(spark.createDataFrame([("k", 2), ("k", 1), ("k", 1)], "k string, v int"), "k", ["v"]).first()["document"])
    assert doc == {"k": "k", "records": [{"v": 1}, {"v": 2}]}


def test_reports(spark, tmp_path):
    e = spark.createDataFrame([("a&b", "c", 2), ("c", "d", None)], "s string, t string, w int")
    S.write_graphml(e, "s", "t", str(tmp_path / "g.xml"), ["w"])
    import xml.etree.ElementTree as ET

    assert len(ET.parse(tmp_path / "g.xml").getroot()[-1]) == 5
    assert S.markdown_table(e, "t").count("\n") == 6
    assert {(r["column"], r["n_nulls"]) for r in S.schema_summary(e).collect()} == {("s", 0), ("t", 0), ("w", 1)}


ANSWERS = [
    ('{"confidence": 0.5, "frame": "x", "dominant_frame": "security"}', (True, "security", 0.5)),
    ('```json\n{"conf": "High", "main_framing": null}\n```', (True, None, 0.85)),
    ('<think>{"no": 1}</think> Sure: {"confidence_score": "0.25"}', (True, None, 0.25)),
    ('{"confidence": 7}', (True, None, None)),
    ('{"confidence": "0.5"', (False, None, None)),
    ("", (False, None, None)),
    (None, (False, None, None)),
    ("[1]", (False, None, None)),
]


def test_answers(spark):
    df = spark.createDataFrame([(i, a[0]) for i, a in enumerate(ANSWERS)], "line_id long, body string")
    for r in N.repaired(df, "body").collect():
        assert (r["readable"], r["frame"], r["confidence"]) == ANSWERS[r["line_id"]][1], ANSWERS[r["line_id"]][0]


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (1, "a", "2024-01-02 00:00:00"), (2, "b", "2024-01-03 00:00:00")], "id long, k string, at string").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = ST.read_stream(spark, str(tmp_path / "in"), df.schema)
    ST.run_to_table(ST.without_redelivery(stream, ["id", "k"], "at"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]
