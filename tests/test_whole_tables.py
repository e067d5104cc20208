"""Queries that once read a part of their tables or names, over small hand-made folders."""

import datetime as dt
import re

import pytest
from plenarium.functions import vocab
from plenarium.operators import annotate as A
from plenarium.operators import mentions as M
from plenarium.plans import annotated, dyads, reports
from plenarium.sources.files import FACTS


def folder_of(spark, tmp_path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_spells_of_all_customers(spark, tmp_path):
    day = dt.date(1995, 1, 1)
    orders = [(1, 7, day), (2, 5000, day), (3, 5000, day + dt.timedelta(60)), (4, 1000, day)]
    lines = [(k, n, 6000 + k, day + dt.timedelta(after)) for k, n, after in [(1, 1, 90), (1, 2, 91), (2, 1, 30), (2, 2, 60), (3, 1, 100), (4, 1, 1), (9, 1, 1)]]
    folder = folder_of(spark, tmp_path, orders=(orders, "o_orderkey long, o_custkey long, o_orderdate date"), lineitem=(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_shipdate date"))
    customer = {k: c for k, c, _ in orders}
    valid = {k * 10 + n: [(start, o) for o, c, start in orders if c == customer.get(k) and start <= shipped <= start + dt.timedelta(90)] for k, n, _, shipped in lines}
    assert sorted((r["line"], r["o_orderkey"]) for r in dyads.d9_all_valid(spark, folder).collect()) == sorted((line, o) for line, found in valid.items() for _, o in found)
    best = {r["line"]: r["o_orderkey"] for r in dyads.d8_best_valid(spark, folder).collect()}
    assert best == {line: max(found)[1] if found else None for line, found in valid.items()}
    assert best == {11: 1, 12: None, 21: 2, 22: 3, 31: 3, 41: 4, 91: None}


def test_all_frames(spark):
    texts = {
        "The backlog grew.": ("bureaucratic_delay", "backlog", "neutral_administrative"),
        "The nation and its border.": ("national_identity", "nation", "neutral_administrative"),
        "Recruit talent.": ("labour_shortage", "recruit", "neutral_administrative"),
        "A media story.": ("media_visibility", "media", "neutral_administrative"),
        "Guard the border.": ("border_crisis", "border", "negative_risk"),
        "Nothing.": ("neutral_reporting", "", "neutral_administrative"),
    }
    df = spark.createDataFrame([(t, t.lower()) for t in texts], "context_window string, context_lower string")
    got = {r["context_window"]: (r["narrative_frame"], r["frame_marker"], r["frame_polarity"]) for r in A.add_framing(df).collect()}
    assert got == texts
    assert len(vocab.FRAMES) == 61 and sum(map(len, vocab.FRAMES.values())) == 226


def fact(i, entity="Turkey", cur="", cat="LOC", topic="immig", speaker="p1", country="GBR", speech="s1"):
    return (i, f"{speech}.{i}", speech, dt.date(2020, 1, 1), speaker, "regular", country, topic, entity, cat, None, None, cur, None, 2.0, "senti:neuneg", dt.datetime(2024, 1, 1))


NAMES = [("TUR", "Turkey", "short"), ("TUR", "Türkiye", "local"), ("UKR", "Україна", "local"), ("VNM", "Việt Nam", "local"), ("CIV", "Côte d'Ivoire", "local"), ("GBR", "United Kingdom", "short"), ("OMN", "Oman", "short")]
NAMED = "iso3 string, country_name string, name_kind string"


def test_flows_of_any_text(spark, tmp_path):
    texts = [
        "They fled from Genève to Besançon.", "Ils vont into Égypte, in Paris – and to Rome.", "Žene from Syria", "ééfrom Spain, to Malta", "from Côte d'Ivoire; towards Île", "Из from Albania in Україна", "plain from Mali to Chad.",
    ]
    folder = folder_of(spark, tmp_path, facts=([fact(i, cur=t) for i, t in enumerate(texts)], FACTS), country_list=(NAMES, NAMED))

    def end(text, words):
        found = (re.search(rf"\b{w}\s+([A-Z][A-Za-zÀ-ÿ' -]{{2,40}})", text) for w in words)
        return next((m[1].strip(" .,;:") for m in found if m), "")

    got = {r["fact_id"]: (r["flow_source"], r["flow_destination"]) for r in reports.g10_flows(spark, folder).collect()}
    assert got == {i: (end(f" || {t} || ", ["from", "leaving"]), end(f" || {t} || ", ["to", "into", "towards", "in"])) for i, t in enumerate(texts)}
    assert got[0] == ("Genève to Besançon", "Besançon") and got[3] == ("", "Malta")


def test_names_in_any_letters(spark, tmp_path, monkeypatch):
    texts = ["Türkiye and Turkey.", "Слава Україна, Україна!", "Việt Nam", "in Côte d'Ivoire", "éOman, Omané, Romania, Oman", None]
    folder = folder_of(spark, tmp_path, facts=([fact(i, cur=t) for i, t in enumerate(texts)], FACTS), country_list=(NAMES, NAMED))
    got = {r["country_name"]: r["n"] for r in reports.i1_named_countries(spark, folder).collect()}
    assert got == {"Türkiye": 1, "Turkey": 1, "Україна": 2, "Việt Nam": 1, "Côte d'Ivoire": 1, "Oman": 1}
    monkeypatch.setattr(reports, "MOST_NAMES", len(NAMES) - 1)
    with pytest.raises(ValueError, match="more than"):
        reports.i1_named_countries(spark, folder)


def test_nested_results_of_all_categories_and_speakers(spark, tmp_path):
    rows = [fact(1, cat="LOC"), fact(2, cat="ORG"), fact(3, cat="PER", speaker=None), fact(4, cat=None, entity=None), fact(5, country="TUR", cat="MISC", speech="s2")]
    again = [(6, *rows[0][1:]), (7, *rows[0][1:8], "Germany", *rows[0][9:])]
    folder = folder_of(spark, tmp_path, facts=(rows + again, FACTS))
    got = {r["country"]: (r["n_records"], r["n_speeches"]) for r in annotated.e35_nested_results(spark, folder).collect()}
    assert got == {"GBR": (5, 1), "TUR": (1, 1)}


def test_scores_and_anchors_off_the_topic(spark, tmp_path):
    rows = [fact(1, cur="To Turkey by boat."), fact(2, cur="Refugees in Turkey.", topic="law"), fact(3, cur="Turkey and Oman.", topic=None), fact(4, cur=None, topic=None)]
    folder = folder_of(spark, tmp_path, facts=(rows, FACTS), country_list=(NAMES, NAMED))
    scores = {r["fact_id"]: r["concreteness_score"] for r in annotated.h4_lexicon_concreteness(spark, folder).collect()}
    assert scores == {1: 3.0, 2: 3.0, 3: 2.5, 4: None}
    found = {r["fact_id"]: r["event_anchors"] for r in annotated.i2_anchors(spark, folder).collect()}
    assert found == {1: "Turkey", 2: "Refugees, Turkey", 3: "Turkey, Oman", 4: ""}


def test_all_places_and_aliases(spark):
    texts = ["From Dublin to Paris.", "La Chapelle", "Col de l'Échelle, Kiev", "Parisian", "Calais"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, x string")
    assert sorted((r["id"], r["place"]) for r in A.locate(df, "id", "x").collect()) == [(0, "Dublin"), (0, "Paris"), (1, "Paris"), (2, "Col de l'Echelle"), (2, "Kyiv"), (4, "Calais")]
    assert len(vocab.PLACES) == 40
    names = spark.createDataFrame([("DEU", "Germany", "short"), ("TUR", "Turkey", "short"), ("CIV", "Ivory Coast", "short"), ("GRC", "Greece", "short")], NAMED)
    facts = spark.createDataFrame([fact(i, n) for i, n in enumerate(["German", "Turkiye", "Côte d'Ivoire", "Ivory Coast", "Athens"])], FACTS)
    assert sorted((r["fact_id"], r["target_iso3"]) for r in A.annotated_mentions(facts, names).collect()) == [(0, "DEU"), (1, "TUR"), (2, "CIV"), (3, "CIV")]
    assert sorted((r["fact_id"], r["target_iso3"]) for r in M.resolve(facts, names).collect()) == [(0, "DEU"), (1, "TUR"), (2, "CIV"), (3, "CIV"), (4, "GRC")]
