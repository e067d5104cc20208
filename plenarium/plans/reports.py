"""Smaller reports over the annotated and the dyadic track: predicates, summaries, selections, chart tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plenarium.functions import text as T
from plenarium.functions import vocab
from plenarium.operators import annotate as A
from plenarium.operators import matrix as X
from plenarium.operators import profiles as P
from plenarium.operators.answers import json_object
from plenarium.operators.index import row_index
from plenarium.operators.mentions import display_label
from plenarium.plans import sqltext as S
from plenarium.plans.annotated import _DOM, _MODE, _W, _facts, _mentions
from plenarium.plans.dyads import _COUNTS, _R, _resolved
from plenarium.sources.tables import table



def _n():
    return F.count(F.lit(1))


def _score():
    return F.col("concreteness_score")


def _mean():
    return T.exact_mean(_score(), 3)


#: The names of countries become one pattern in the driver.
MOST_NAMES = 50_000
TARGET_YEAR = ["entity_name", "source_year", "target_iso3", "weog_group", "region_group"]
KEY_TARGETS = ["UKR", "SYR", "TUR", "DEU", "GRC", "AFG", "ITA"]


def b10_regex(spark, folder):
    """Rows that name a ministry or committee, or whose sentence speaks of quotas."""
    hit = F.col("entity_content").rlike("(?i)^(ministry|committee)") | F.coalesce(F.col("sentence_content_current").rlike("(?i)quota"), F.lit(False))
    return _facts(spark, folder).where(hit).select("fact_id")


def b11_without_markers(spark, folder):
    low = F.lower("sentence_content_current")
    return _facts(spark, folder, "fact_id", "sentence_content_current").where(~T.contains_any(low, ["border", "asylum", "minors"])).select("fact_id")


def b12_prefix_and_length(spark, folder):
    c = F.col("entity_content")
    return _facts(spark, folder, "fact_id", "entity_content").where(c.startswith("Republic of") | (F.char_length(c) > 40)).select("fact_id")


def b13_text_dates(spark, folder):
    """Rows between two dates written as text, compared as text."""
    day = F.date_format("session_date", "yyyy-MM-dd")
    return _facts(spark, folder, "fact_id", "session_date").where((day > "2015") & (day < "2016")).select("fact_id")


def b19_row_index(spark, folder):
    return row_index(table(spark, folder, "task9_ukraine_yearly_attention", "attention_id", "country"), "attention_id").select("attention_id", "row_index")


def b20_reverse_names(spark, folder):
    """Directed counts with both ends exchanged."""
    counts = _resolved(spark, folder).groupBy("country", "target_iso3").agg(_n().alias("n"))
    return counts.withColumnsRenamed({"country": "target", "target_iso3": "source", "n": "n_reverse"})


def c12_frame_bucket(spark, folder):
    bucket = F.when(F.col("frame_polarity").startswith("positive"), "benefit").when(F.col("frame_polarity").startswith("negative"), "risk").otherwise("neutral")
    return _mentions(spark, folder).groupBy(bucket.alias("bucket"), "country").agg(_n().alias("n"))


def c16_fact_score(spark, folder):
    """The score of a mention as a fact: 5.0 if it is dated or has a year in its text, else its concreteness."""
    dated = F.col("session_date").isNotNull() | (T.years(F.col("context_window")) > 0)
    return _mentions(spark, folder).select("fact_id", F.when(dated, 5.0).otherwise(_score()).alias("fact_score"))


def c19_display_label(spark, folder):
    labels = _mentions(spark, folder).select("entity_name", display_label(F.col("entity_name"), F.col("geo_class")).alias("label"))
    return labels.groupBy("entity_name", "label").agg(_n().alias("n"))


def d11_top_semi(spark, folder):
    """Mentions of the ten most named targets, by year."""
    m = _mentions(spark, folder)
    top = P.distribution(m, "entity_name", top=10).select("entity_name")
    return m.join(top, "entity_name", "left_semi").groupBy("entity_name", "source_year").agg(_n().alias("n"))


def d12_not_located(spark, folder):
    """Concrete mentions in which no known place is named."""
    events = A.concrete_events(_mentions(spark, folder)).select("fact_id", "context_window")
    return events.join(A.locate(events, "fact_id", "context_window"), "fact_id", "left_anti").select("fact_id")


def e17_visible_targets(spark, folder):
    out = P.profile(_mentions(spark, folder).where(_score() >= 3.3), ["entity_name", "target_iso3", "weog_group"], ["narrative_frame", "policy_agency"], means={"concreteness_score": 3})
    return out.withColumnRenamed("mean_concreteness_score", "mean_score").withColumn("mean_score", F.round("mean_score", 3))


def e20_target_year(spark, folder):
    m = _mentions(spark, folder).where("concreteness_score is not null")
    return m.groupBy(*TARGET_YEAR).agg(_n().alias("n"), F.round(_mean(), 3).alias("mean_score"), F.round(F.median(_score()), 4).alias("median_score"), *P.modes(["narrative_frame", "policy_agency", "migration_direction"]))


def e23_year_summary(spark, folder):
    """Per year: mentions, mean score and the first label (by day, then row) other than the default."""
    named = F.when(F.col("policy_measure") != "unspecified", F.struct("session_date", "fact_id"))
    return _mentions(spark, folder).groupBy("source_year").agg(_n().alias("n"), F.round(_mean(), 3).alias("mean_score"), F.min_by("policy_measure", named).alias("first_measure"))


def e26_top_facts(spark, folder):
    m = _mentions(spark, folder).where("concreteness_score is not null").select("country", "fact_id", "concreteness_score")
    return P.both_ends(m, "country", "concreteness_score", "fact_id", 5).where("example_type = 'highest'").select("country", "fact_id", "place")


def e30_source_totals(spark, folder):
    """Mentions and tokens of context per source, the denominators of rates."""
    return _mentions(spark, folder).groupBy("country").agg(_n().alias("n"), F.sum("n_tokens").alias("n_tokens"), (_n() * 1000.0 / F.sum("n_tokens")).alias("per_thousand"))


def e37_distinct(spark, folder):
    """Different values of some columns; a null counts as one in the second figure of each."""
    cols = ["speaker_id", "debate_topic", "entity_content"]
    counts = [F.count_distinct(c).alias(f"n_{c}") for c in cols]
    with_null = [(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(f"n_{c}_or_null") for c in cols]
    return _facts(spark, folder, *cols).agg(*counts, *with_null)


def e38_rollup(spark, folder):
    return _mentions(spark, folder).groupBy("narrative_frame", "frame_polarity", "argument_scheme").agg(_n().alias("n"))


def e39_source_order(spark, folder):
    """Sources by the number of their mentions (ties by name), with their place."""
    counts = _mentions(spark, folder).groupBy("country").agg(_n().alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "country")).cast("long"))


def e32_lenient_mean(spark, folder):
    """Mean confidence of answers per task, numbers and number-like text alike."""
    value = F.try_variant_get(json_object(F.col("body")), "$.confidence", "string").try_cast("double")
    return table(spark, folder, "task_runs", "task", "body").groupBy("task").agg(F.count(value).alias("n"), T.exact_mean(value, 3).alias("mean_confidence"))


def f5_tokens(spark, folder):
    """The most frequent words of current sentences."""
    words = _facts(spark, folder, "sentence_content_current").select(F.explode(T.tokens(F.col("sentence_content_current"))).alias("word"))
    return P.distribution(words, "word", top=50)


def g10_flows(spark, folder):
    return _mentions(spark, folder).select("fact_id", "flow_source", "flow_destination")


def i1_named_countries(spark, folder):
    """Countries named anywhere in the current sentence, by name, longest name first."""
    names = sorted(r[0] for r in table(spark, folder, "country_list", "country_name").where("country_name <> ''").distinct().limit(MOST_NAMES + 1).collect())
    if len(names) > MOST_NAMES:
        raise ValueError(f"the list of names has more than {MOST_NAMES} entries")
    found = A.named_countries(F.col("sentence_content_current"), names)
    return _facts(spark, folder, "fact_id", "sentence_content_current").select("fact_id", F.explode(found).alias("country_name")).groupBy("country_name").agg(_n().alias("n"))


def i4_europe_events(spark, folder):
    europe = F.col("target_iso3").isin(vocab.EUROPE) | F.col("entity_name").isin(vocab.UNION)
    return _mentions(spark, folder).where((_score() >= 3.3) & F.coalesce(europe, F.lit(False))).select("fact_id", "entity_name", "concreteness_score")


def j6_leading_scope(spark, folder):
    """Per geography: the target with the most mentions (ties by name)."""
    counts = _mentions(spark, folder).groupBy("geo_class", "entity_name").agg(_n().alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("minus"), "entity_name")).alias("b")
    return counts.groupBy("geo_class").agg(best).select("geo_class", F.col("b.entity_name").alias("entity_name"), (-F.col("b.minus")).alias("n"))


def j7_global_top(spark, folder):
    return _mentions(spark, folder).select("fact_id", "concreteness_score").where("concreteness_score is not null").orderBy(F.desc("concreteness_score"), "fact_id").limit(25)


def j12_common_names(spark, folder):
    """Entities named by both of two parliaments."""
    facts = _facts(spark, folder, "country", "entity_content")
    return facts.where("country = 'GBR'").select("entity_content").intersect(facts.where("country = 'TUR'").select("entity_content")).where("entity_content is not null")


def k4_snippets(spark, folder):
    rows = P.sample_per_stratum(_facts(spark, folder).where(F.char_length("sentence_content_current") > 40), ["country"], "fact_id", 2)
    return rows.select("fact_id", T.snippet(F.col("sentence_content_previous"), F.col("sentence_content_current"), F.col("sentence_content_next")).alias("snippet"))


def m3_target_counts(spark, folder):
    counts = _resolved(spark, folder).groupBy("country", "target_iso3").agg(_n().alias("n"))
    return counts.join(X.top_columns(counts, "target_iso3", "n", 35), "target_iso3", "left_semi")


def m12_extreme_cells(spark, folder):
    cells = X.masked_means(_resolved(spark, folder), "country", "target_iso3", "sentence_sentiment_value").where("mean_value is not null").select(F.col("country").alias("a"), F.col("target_iso3").alias("b"), F.round("mean_value", 6).alias("mean_value"))
    return X.extremes(cells, "mean_value", 8)


def m13_share_leaders(spark, folder):
    """Labels with at least 5 % of a source's mentions and their first five sources, generic labels left out."""
    counts = _mentions(spark, folder).where("policy_measure <> 'unspecified'").groupBy("country", "policy_measure").agg(_n().alias("n"))
    totals = _mentions(spark, folder).groupBy("country").agg(_n().alias("total"))
    shares = counts.join(totals, "country").withColumn("share", F.round(F.col("n") / F.col("total"), 6)).where("share >= 0.05")
    place = F.row_number().over(Window.partitionBy("policy_measure").orderBy(F.desc("share"), "country")).cast("long")
    return shares.withColumn("place", place).where("place <= 5").select("policy_measure", "country", "share", "place")


def n6_event_selection(spark, folder):
    """Concrete mentions for a model to look at: aggregates left out, at most eight per target."""
    chosen = _mentions(spark, folder).where((_score() >= 3.5) & (F.col("geo_class") == "foreign")).select("fact_id", "entity_name")
    return P.sample_per_stratum(chosen, ["entity_name"], "fact_id", 8)


def n8_cross_target(spark, folder):
    """How each source speaks of the key targets (at least five mentions)."""
    m = _mentions(spark, folder).where(F.col("target_iso3").isin(KEY_TARGETS))
    return m.groupBy("country", "target_iso3").agg(_n().alias("n"), *P.modes(["policy_agency", "narrative_frame"])).where("n >= 5")


def n9_direction_selection(spark, folder):
    """Mentions inbound and outbound per parliament with at least 20 of them."""
    d = F.col("migration_direction")
    return _mentions(spark, folder).groupBy("country").agg(F.count_if(d == "inbound_internal").alias("n_inbound"), F.count_if(d == "outbound_from_domestic").alias("n_outbound"), _n().alias("n")).where("n >= 20")


def v4_mean_by_year(spark, folder):
    m = _mentions(spark, folder)
    return m.groupBy("region_group", "source_year").agg(_n().alias("n"), _mean().alias("mean_score"), F.mode("concreteness_band", deterministic=True).alias("dominant_concreteness_band"))


def v5_top_by_agency(spark, folder):
    m = _mentions(spark, folder)
    top = P.distribution(m, "entity_name", top=15).select("entity_name")
    return m.join(top, "entity_name", "left_semi").groupBy("entity_name", "policy_agency").agg(_n().alias("n"))


def v8_timeline(spark, folder):
    """The 40 most concrete mentions with excerpts, as a time line shows them."""
    rows = _mentions(spark, folder).where("concreteness_score is not null").orderBy(F.desc("concreteness_score"), "session_date", "fact_id").limit(40)
    return rows.select("fact_id", "session_date", "entity_name", "concreteness_score", T.excerpt(F.col("context_window"), 200).alias("excerpt"))


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and n[1:2].isdigit()}

_AVG = "avg(cast(round(concreteness_score * 1000) AS bigint)) / 1000"
_SHORT = r"trim(regexp_replace(replace(context_window, '||', ' '), '\s+', ' ', 'g'))"
_PLACE = r"[A-Z][A-Za-zÀ-ÿ'' -]{2,40}"
_FLOW = lambda words: "coalesce(" + ", ".join(rf"nullif(trim(regexp_extract(context_window, '(?:^|{S.EDGE}){w}[\s\p{{Z}}]+({_PLACE})', 1), ' .,;:'), '')" for w in words) + ", '')"
_NAMED = "|".join(a for _, names, *_ in vocab.PLACES for a in names)

ORACLE = {
    "b10_regex": "SELECT fact_id FROM facts WHERE regexp_matches(entity_content, '(?i)^(ministry|committee)') OR coalesce(regexp_matches(sentence_content_current, '(?i)quota'), false)",
    "b11_without_markers": f"SELECT fact_id FROM facts WHERE NOT {S.any_marker('lower(sentence_content_current)', ['border', 'asylum', 'minors'])}",
    "b12_prefix_and_length": "SELECT fact_id FROM facts WHERE starts_with(entity_content, 'Republic of') OR len(entity_content) > 40",
    "b13_text_dates": "SELECT fact_id FROM facts WHERE strftime(session_date, '%Y-%m-%d') > '2015' AND strftime(session_date, '%Y-%m-%d') < '2016'",
    "b19_row_index": "SELECT attention_id, row_number() OVER (ORDER BY attention_id) - 1 AS row_index FROM task9_ukraine_yearly_attention",
    "b20_reverse_names": _COUNTS + " SELECT country AS target, target_iso3 AS source, n AS n_reverse FROM counts",
    "c12_frame_bucket": _W + " SELECT CASE WHEN starts_with(frame_polarity, 'positive') THEN 'benefit' WHEN starts_with(frame_polarity, 'negative') THEN 'risk' ELSE 'neutral' END AS bucket, country, count(*) AS n FROM mentions GROUP BY 1, 2",
    "c16_fact_score": _W + r" SELECT fact_id, CASE WHEN session_date IS NOT NULL OR len(regexp_extract_all(context_window, '\b(19|20)\d{2}\b')) > 0 THEN 5.0 ELSE concreteness_score END AS fact_score FROM mentions",
    "c19_display_label": _W + " SELECT entity_name, entity_name || CASE geo_class WHEN 'european_union' THEN ' (EU)' WHEN 'territory_region' THEN ' (overseas)' ELSE '' END AS label, count(*) AS n FROM mentions GROUP BY 1, 2",
    "d11_top_semi": _W + ", top AS (SELECT entity_name FROM mentions GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10) SELECT entity_name, source_year, count(*) AS n FROM mentions WHERE entity_name IN (SELECT entity_name FROM top) GROUP BY 1, 2",
    "d12_not_located": _W + f" SELECT fact_id FROM mentions WHERE concreteness_score >= 3.3 AND NOT coalesce(regexp_matches(context_window, {S.quoted(rf'(^|{S.EDGE})({_NAMED})({S.EDGE}|$)')}), false)",
    "e17_visible_targets": _W + f", v AS (SELECT * FROM mentions WHERE concreteness_score >= 3.3), g AS (SELECT entity_name, target_iso3, weog_group, count(*) AS n, round({_AVG}, 3) AS mean_score FROM v GROUP BY 1, 2, 3) SELECT g.*, " + _DOM(["narrative_frame", "policy_agency"]) + " FROM g" + _MODE("entity_name, target_iso3, weog_group", ["narrative_frame", "policy_agency"], "v"),
    "e20_target_year": _W + f", v AS (SELECT * FROM mentions WHERE concreteness_score IS NOT NULL), g AS (SELECT {', '.join(TARGET_YEAR)}, count(*) AS n, round({_AVG}, 3) AS mean_score, round(median(concreteness_score), 4) AS median_score FROM v GROUP BY ALL) SELECT g.*, " + _DOM(["narrative_frame", "policy_agency", "migration_direction"]) + " FROM g" + _MODE(", ".join(TARGET_YEAR), ["narrative_frame", "policy_agency", "migration_direction"], "v"),
    "e23_year_summary": _W + f" SELECT source_year, count(*) AS n, round({_AVG}, 3) AS mean_score, arg_min(policy_measure, {{'d': session_date, 'f': fact_id}}) FILTER (policy_measure <> 'unspecified') AS first_measure FROM mentions GROUP BY 1",
    "e26_top_facts": _W + " SELECT country, fact_id, row_number() OVER (PARTITION BY country ORDER BY concreteness_score DESC, fact_id) AS place FROM mentions WHERE concreteness_score IS NOT NULL QUALIFY place <= 5",
    "e30_source_totals": _W + " SELECT country, count(*) AS n, cast(sum(n_tokens) AS bigint) AS n_tokens, count(*) * 1000.0 / sum(n_tokens) AS per_thousand FROM mentions GROUP BY 1",
    "e37_distinct": "SELECT " + ", ".join(f"count(DISTINCT {c}) AS n_{c}, count(DISTINCT {c}) + max(cast({c} IS NULL AS int)) AS n_{c}_or_null" for c in ("speaker_id", "debate_topic", "entity_content")) + " FROM facts",
    "e38_rollup": _W + " SELECT narrative_frame, frame_polarity, argument_scheme, count(*) AS n FROM mentions GROUP BY 1, 2, 3",
    "e39_source_order": _W + " SELECT country, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, country) AS place FROM mentions GROUP BY 1",
    "f5_tokens": f"WITH w AS (SELECT unnest({S.TOKENS.format('sentence_content_current')}) AS word FROM facts) SELECT word, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, word LIMIT 50",
    "g10_flows": _W + f" SELECT fact_id, {_FLOW(['from', 'leaving'])} AS flow_source, {_FLOW(['to', 'into', 'towards', 'in'])} AS flow_destination FROM mentions",
    "i4_europe_events": _W + f" SELECT fact_id, entity_name, concreteness_score FROM mentions WHERE concreteness_score >= 3.3 AND coalesce(target_iso3 IN {S.within(vocab.EUROPE)} OR entity_name IN {S.within(vocab.UNION)}, false)",
    "j6_leading_scope": _W + ", c AS (SELECT geo_class, entity_name, count(*) AS n FROM mentions GROUP BY 1, 2) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY geo_class ORDER BY n DESC, entity_name) = 1",
    "j7_global_top": _W + " SELECT fact_id, concreteness_score FROM mentions WHERE concreteness_score IS NOT NULL ORDER BY concreteness_score DESC, fact_id LIMIT 25",
    "j12_common_names": "SELECT entity_content FROM facts WHERE country = 'GBR' AND entity_content IS NOT NULL INTERSECT SELECT entity_content FROM facts WHERE country = 'TUR'",
    "k4_snippets": """WITH s AS (SELECT * FROM facts WHERE len(sentence_content_current) > 40 QUALIFY row_number() OVER (PARTITION BY country ORDER BY md5(cast(fact_id AS varchar) || '42'), fact_id) <= 2)
        SELECT fact_id, 'prev: ' || substring(coalesce(sentence_content_previous, ''), 1, 300) || ' | cur: ' || substring(sentence_content_current, 1, 300) || ' | next: ' || substring(coalesce(sentence_content_next, ''), 1, 300) AS snippet FROM s""",
    "m3_target_counts": _COUNTS + " SELECT * FROM counts WHERE target_iso3 IN (SELECT target_iso3 FROM counts GROUP BY 1 ORDER BY sum(n) DESC, 1 LIMIT 35)",
    "m12_extreme_cells": _R + """, c AS (SELECT country AS a, target_iso3 AS b, round(avg(cast(round(sentence_sentiment_value * 10000) AS bigint)) / 10000, 6) AS mean_value FROM resolved GROUP BY 1, 2 HAVING count(*) >= 20), t AS (SELECT * FROM c WHERE mean_value IS NOT NULL)
        (SELECT *, 'closest' AS kind FROM t ORDER BY mean_value DESC, a, b LIMIT 8) UNION ALL (SELECT *, 'divergent' FROM t ORDER BY mean_value, a, b LIMIT 8)""",
    "m13_share_leaders": _W + """, t AS (SELECT country, count(*) AS total FROM mentions GROUP BY 1), s AS (SELECT policy_measure, country, round(count(*) / any_value(total), 6) AS share FROM mentions JOIN t USING (country) WHERE policy_measure <> 'unspecified' GROUP BY 1, 2)
        SELECT *, row_number() OVER (PARTITION BY policy_measure ORDER BY share DESC, country) AS place FROM s WHERE share >= 0.05 QUALIFY place <= 5""",
    "n6_event_selection": _W + " SELECT fact_id, entity_name FROM mentions WHERE concreteness_score >= 3.5 AND geo_class = 'foreign' QUALIFY row_number() OVER (PARTITION BY entity_name ORDER BY md5(cast(fact_id AS varchar) || '42'), fact_id) <= 8",
    "n8_cross_target": _W + f", v AS (SELECT * FROM mentions WHERE target_iso3 IN {S.within(KEY_TARGETS)}), g AS (SELECT country, target_iso3, count(*) AS n FROM v GROUP BY 1, 2 HAVING count(*) >= 5) SELECT g.*, " + _DOM(["policy_agency", "narrative_frame"]) + " FROM g" + _MODE("country, target_iso3", ["policy_agency", "narrative_frame"], "v"),
    "n9_direction_selection": _W + " SELECT country, count(*) FILTER (migration_direction = 'inbound_internal') AS n_inbound, count(*) FILTER (migration_direction = 'outbound_from_domestic') AS n_outbound, count(*) AS n FROM mentions GROUP BY 1 HAVING count(*) >= 20",
    "v4_mean_by_year": _W + f", g AS (SELECT region_group, source_year, count(*) AS n, {_AVG} AS mean_score FROM mentions GROUP BY 1, 2) SELECT g.*, " + _DOM(["concreteness_band"]) + " FROM g" + _MODE("region_group, source_year", ["concreteness_band"]),
    "v5_top_by_agency": _W + ", top AS (SELECT entity_name FROM mentions GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 15) SELECT entity_name, policy_agency, count(*) AS n FROM mentions WHERE entity_name IN (SELECT entity_name FROM top) GROUP BY 1, 2",
    "v8_timeline": _W + f", c AS (SELECT *, {_SHORT} AS short FROM mentions WHERE concreteness_score IS NOT NULL ORDER BY concreteness_score DESC, session_date, fact_id LIMIT 40) SELECT fact_id, session_date, entity_name, concreteness_score, CASE WHEN len(short) > 200 THEN rtrim(substring(short, 1, 197)) || '...' ELSE short END AS excerpt FROM c",
}
