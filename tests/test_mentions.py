"""Filters, text rules, annotations and dyads over a small hand-made fact table, against rules written out in Python."""

import datetime as dt
import re

import pytest
from plenarium.functions import text as T
from plenarium.functions import vocab
from plenarium.operators import annotate as A
from plenarium.operators import dyadic as D
from plenarium.operators import mentions as M
from plenarium.operators import profiles as P
from plenarium.sources.files import FACTS
from pyspark.sql import functions as F

DAY = dt.date(2022, 2, 24)


def fact(i, entity, country="GBR", cat="LOC", topic="immig", prev=None, cur="They signed a treaty.", nxt=None, speech="s1", day=DAY, speaker="p1", value=2.0, ana="senti:neuneg", sentence=None):
    return (i, sentence or f"{speech}.{i}", speech, day, speaker, "regular", country, topic, entity, cat, None, prev, cur, nxt, value, ana, dt.datetime(2024, 1, 1))


ROWS = [
    fact(1, "Turkey", cur="The refugees crossed the border from Syria to Turkey in 2015."),
    fact(2, "Germany", country="DEU", cur=None, prev="x"),
    fact(3, "United Kingdom", country="GBR"),
    fact(4, "EU", cat="ORG", cur="Therefore a refugee is a person without a home, and we must act."),
    fact(5, "Sahel", topic=None, cur="Asylum seekers wait in camps."),
    fact(6, "Turkey", country="DEU", topic="law", cur="Nothing here.", speech="s2"),
    fact(7, "Pays-Bas", speech="s1", cur="University students need a visa."),
    fact(8, None, cat=None, speaker=None, value=None, ana=None),
    fact(9, "", cur=""),
    fact(10, "UK", country="TUR", speech="s3", day=DAY - dt.timedelta(days=90), value=1.0, ana="senti:other"),
    fact(11, "United Kingdom", country="TUR", speech="s3", day=DAY + dt.timedelta(days=90), value=3.0),
    fact(12, "United Kingdom", country="TUR", speech="s3", day=DAY + dt.timedelta(days=91)),
    fact(13, "Merkel", cat="PER", sentence="s1.1"),
]
NAMES = [("TUR", "Turkey", "short"), ("DEU", "Germany", "short"), ("GBR", "United Kingdom", "short"), ("GBR", "UK", "abbreviation"), ("NLD", "Netherlands", "short"), ("TUR", "Türkiye", "local")]


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame(ROWS, FACTS).cache()


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame(NAMES, "iso3 string, country_name string, name_kind string").cache()


def ids(df):
    return sorted(r["fact_id"] for r in df.collect())


def test_filters(facts):
    assert ids(M.filter_topic(facts, True, False)) == [1, 2, 3, 4, 7, 8, 9, 10, 11, 12, 13]
    assert ids(M.filter_topic(facts, False, True)) == [1, 4, 5]
    assert ids(M.filter_topic(facts, True, True)) == [1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12, 13]
    assert M.filter_topic(facts, False, False).count() == len(ROWS)
    assert 4 in ids(M.filter_places(facts)) and 13 not in ids(M.filter_places(facts))
    assert ids(M.filter_foreign(facts, ["Turkey", ""])) == [2, 3, 4, 5, 7, 10, 11, 12, 13]
    assert 3 not in ids(M.drop_domestic(facts)) and 8 in ids(M.drop_domestic(facts))


def test_text_rules(spark):
    df = spark.createDataFrame([("Côte d'Ivoire",), ("Pays-Bas",), ("  U.S. ",), (None,), ("",)], "x string")
    assert [r[0] for r in df.select(T.normal(F.col("x"))).collect()] == ["côte d ivoire", "pays bas", "u s", None, ""]
    assert [r[0] for r in df.select(T.normal(F.col("x"), compat=True)).collect()] == ["côte divoire", "paysbas", "us", None, ""]
    df = spark.createDataFrame([("3.5 in 1999 and 2020x, 7", "a || b   c"), ("", "x" * 400)], "x string, y string")
    assert [tuple(r) for r in df.select(T.numbers(F.col("x")), T.years(F.col("x")), T.spaced_tokens(F.col("x"))).collect()] == [(3, 1, 6), (0, 0, 1)]
    assert [r[0] for r in df.select(T.excerpt(F.col("y"), 360)).collect()] == ["a b c", "x" * 357 + "..."]
    df = spark.createDataFrame([("2020-01-05",), ("2020-13-05",), ("2020",), (None,)], "x string")
    assert [r[0] for r in df.select(T.lenient_date(F.col("x"))).collect()] == [dt.date(2020, 1, 5), None, None, None]
    tokens = spark.createDataFrame([("The Border-guards didn't act, a B x1",)], "x string").select(T.tokens(F.col("x"))).first()[0]
    assert tokens == ["border-guards", "didn't", "act"]


def _reference_type(text):
    if text is None or not text.strip():
        return "unknown"
    p, s = (sum(m.lower() in text.lower() for m in set(ms)) for ms in (vocab.POLICY, vocab.SITUATION))
    if p == s == 0:
        return "neutral_reference"
    if p >= 2 and s >= 2 or p == s:
        return "mixed"
    return "policy" if p > s else "situation"


def _ordered(text, classes, default):
    return next((c for c, ms in classes.items() if any(m in (text or "").lower() for m in ms)), default)


def _concreteness(text, entity):
    tok = lambda x: [t.lower() for t in re.findall(T.TOKEN, x or "") if t.lower() not in vocab.STOPWORDS]
    own, ts = set(tok(entity)), tok(text)
    if not ts:
        return None
    score = lambda t: 5.0 if t in own else 4.5 if t in vocab.CONCRETE else 2.0 if t in vocab.ABSTRACT else 2.6 if t.endswith(("tion", "ity", "ism", "ness", "ment")) else 3.2
    return round(sum(map(score, ts)) / len(ts), 3)


def test_annotations_match_the_written_rules(facts, names):
    seen = 0
    for r in A.annotate(facts, names).collect():
        w = r["context_window"]
        assert (w is None) == (r["sentence_content_current"] is None)
        assert r["ref_type"] == _reference_type(w)
        assert r["migrant_cohort"] == _ordered(w, vocab.COHORTS, "unspecified")
        assert r["policy_measure"] == _ordered(w, vocab.MEASURES, "unspecified")
        assert r["policy_agency"] == _ordered(w, vocab.AGENCY, "neutral_reporting")
        assert r["narrative_frame"] == _ordered(w, vocab.FRAMES, "neutral_reporting")
        assert r["concreteness_score"] == (None if (c := _concreteness(w, r["entity_content"])) is None else pytest.approx(c))
        assert r["sentiment_level"] == (r["sentence_sentiment_ana"] if r["sentence_sentiment_ana"] in vocab.SENTIMENTS else "unknown")
        seen += 1
    assert seen == len(ROWS)


def test_single_labels(facts, names):
    by = {r["fact_id"]: r for r in A.annotate(facts, names).collect()}
    assert by[4]["argument_scheme"] == "conceptual_definition" and by[4]["definition_snippet"].startswith("Therefore a refugee is")
    assert by[4]["geo_class"] == "european_union" and by[5]["geo_class"] == "analytical_region" and by[9]["entity_scope"] == "invalid"
    assert by[1]["flow_source"].startswith("Syria") and by[1]["target_iso3"] == "TUR" and by[2]["migration_direction"] == "ambiguous"
    assert by[7]["entity_name"] == "Netherlands" and by[7]["weog_group"] == "weog"
    assert by[2]["concreteness_band"] == "unknown" and by[2]["frame_marker"] == ""
    kept = A.annotated_mentions(facts, names).collect()
    assert {r["entity_scope"] for r in kept} <= {"country", "european_union", "territory_region", "analytical_region"}
    assert all(r["target_iso3"] for r in kept if r["entity_scope"] == "country") and all(r["target_iso3"] != r["country"] for r in kept)


def test_longest_marker_of_the_first_class(spark):
    df = spark.createDataFrame([("asylum seekers and refugees",), (None,)], "x string")
    assert [r[0] for r in df.select(T.class_marker(F.col("x"), vocab.COHORTS)).collect()] == ["refugees", ""]
    assert [r[0] for r in df.select(T.first_marker(F.col("x"), ["asylum", "asylum seekers"])).collect()] == ["asylum seekers", ""]


def test_resolver_is_unique_and_skips_own_country(facts, names):
    table = M.resolver(names)
    assert table.count() == table.select("alias_normal").distinct().count()
    got = {(r["fact_id"], r["target_iso3"]) for r in M.resolve(facts, names).collect()}
    assert (7, "NLD") in got and (10, "GBR") in got and not any(i == 3 for i, _ in got) and not any(i in (8, 9, 13) for i, _ in got)
    assert {r["speech_id"] for r in M.topic_speeches(facts).collect()} == {"s1", "s3"}


def test_dyads(facts, names):
    r = D.topic_resolved(facts, names).cache()
    matrix = {(x["country"], x["target_iso3"]): x for x in D.bilateral_matrix(r).collect()}
    assert matrix["TUR", "GBR"]["n_mentions"] == 3 and matrix["GBR", "TUR"]["sd_sentiment"] is None
    shock = {(x["country"], x["target_iso3"]): x for x in D.shock_window(r, str(DAY), 90).collect()}
    assert (shock["TUR", "GBR"]["n_pre"], shock["TUR", "GBR"]["n_post"]) == (1, 1)
    a = D.asymmetry(D.bilateral_matrix(r)).collect()
    assert [(x["a"], x["b"], x["n_ab"], x["n_ba"]) for x in a] == [("GBR", "TUR", 1, 3)]
    ratio = {(x["source"], x["target"]): x["ratio"] for x in D.directed_ratio(D.bilateral_matrix(r)).collect()}
    assert ratio["TUR", "GBR"] == 1.5 and ratio["GBR", "NLD"] == 1.0
    scope = {(x["country"], x["target_iso3"]): x["analysis_scope"] for x in D.yearly_attention(r).collect()}
    assert scope["GBR", "TUR"] == "reciprocal_asymmetry_candidate" and scope["GBR", "NLD"] == "external_target"


def test_validity_joins(spark):
    m = spark.createDataFrame([(1, "p", DAY), (2, "p", dt.date(2000, 1, 1)), (3, "q", DAY), (4, None, DAY)], "id long, person string, day date")
    a = spark.createDataFrame([("p", dt.date(2020, 1, 1), None, "new"), ("p", dt.date(2010, 1, 1), dt.date(2030, 1, 1), "old"), ("p", None, dt.date(1999, 1, 1), "gone"), ("q", None, None, "open"), ("q", DAY, None, "today")], "person string, start date, stop date, org string")
    best = {r["id"]: r["org"] for r in D.best_valid(m, a, ["person"], "day", "start", "stop", ["org"]).collect()}
    assert best == {1: "new", 2: None, 3: "open", 4: None}
    assert sorted((r["id"], r["org"]) for r in D.all_valid(m, a, ["person"], "day", "start", "stop").collect()) == [(1, "new"), (1, "old"), (3, "today")]


def test_profiles(spark):
    df = spark.createDataFrame([("a", "x", 1.0, 1), ("a", "y", 2.0, 2), ("a", None, 3.0, 3), ("b", "y", 1.0, 4)], "g string, v string, s double, id long")
    assert {(r["g"], r["dominant_v"]) for r in df.groupBy("g").agg(*P.modes(["v"])).collect()} == {("a", "x"), ("b", "y")}
    p = {r["g"]: r.asDict() for r in P.profile(df, ["g"], ["v"], ["v"], ["v"], {"s": 1}, ["id"]).collect()}
    assert p["a"] == {"g": "a", "n": 3, "n_v": 2, "mean_s": 2.0, "first_id": 1, "last_id": 3, "dominant_v": "x", "v_seen": "x, y"}
    assert p["b"] == {"g": "b", "n": 1, "n_v": 1, "mean_s": 1.0, "first_id": 4, "last_id": 4, "dominant_v": "y", "v_seen": "y"}
    assert P.profile(df.limit(0), ["g"], ["v"]).count() == 0
    ends = P.both_ends(df, "g", "s", "id", 2).collect()
    assert len([r for r in ends if r["g"] == "b"]) == 2 and len([r for r in ends if r["g"] == "a"]) == 4
    trend = P.trend(spark.createDataFrame([("k", 2020, 5), ("k", 2021, 9), ("k", 2022, 9), ("k", 2023, 1)], "k string, y int, n long"), "k", "y", "n").first()
    assert (trend["peak_year"], trend["peak_value"], trend["delta"]) == (2021, 9, -4)
    assert P.sample_rows(df, "id", 2).collect() == P.sample_rows(df.repartition(3), "id", 2).collect()
    other = {r["v"]: r["count"] for r in P.top_share(df, "v", 1).groupBy("v").count().collect()}
    assert other == {"y": 2, "other": 2}
    js = P.top_values_json(df, "g", ["v"], 1).where("g = 'a'").first()["distribution"]
    assert js == '[{"value":"x","n":1,"share":0.5}]'


def test_everything_runs_on_an_empty_table(spark, names):
    none = spark.createDataFrame([], FACTS)
    assert A.annotated_mentions(none, names).count() == 0
    r = D.topic_resolved(none, names)
    assert D.asymmetry(D.bilateral_matrix(r)).count() == D.shock_window(r, str(DAY)).count() == D.yearly_attention(r).count() == 0
