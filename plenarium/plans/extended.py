"""Queries over the annotated mentions and model answers: comparative features, pairs of parliaments, chart and event
tables, prompts and checked answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenarium.functions import text as T
from plenarium.operators import annotate as A
from plenarium.operators import answers as N
from plenarium.operators import dyadic as D
from plenarium.operators import matrix as X
from plenarium.operators import profiles as P
from plenarium.plans import annotated, dyads, reports
from plenarium.plans import sqltext as S
from plenarium.plans.annotated import _DOM, _MODE, _W
from plenarium.plans.dyads import _A, _M, _R, SHOCK
from plenarium.sources.tables import table

LEVELS = ["entity_scope", "policy_measure", "migrant_cohort", "policy_agency", "frame_polarity", "narrative_frame", "argument_scheme", "migration_direction", "sentiment_polarity", "concreteness_band"]
TEMPLATE = "Parliament: %s\nMentions of %s\n\n%s\n\nAnswer with one JSON object."


def _mentions(spark, folder):
    return annotated._mentions(spark, folder)


def _n():
    return F.count(F.lit(1)).alias("n")


def _features(spark, folder):
    return X.comparative_features(_mentions(spark, folder), "country", LEVELS, "entity_name", 25, {"concreteness_score": 3, "sentence_sentiment_value": 4}, {"log_speeches": "speech_id", "log_speakers": "speaker_id"})


def m6_features(spark, folder):
    return _features(spark, folder)


def m7_zscores(spark, folder):
    return X.zscores(_features(spark, folder), "country").select("country", "feature", F.round("z", 6).alias("z"))


def m8_cosine(spark, folder):
    return X.cosine(X.zscores(_features(spark, folder), "country"), "country", "z").select("a", "b", F.round("similarity", 6).alias("similarity"))


def m9_extremes(spark, folder):
    return X.extremes(m8_cosine(spark, folder), "similarity")


def m10_signatures(spark, folder):
    return X.signatures(X.zscores(_features(spark, folder), "country").withColumn("z", F.round("z", 9)), "country")


def m17_convergence_pairs(spark, folder):
    """Pairs of parliaments with similar profiles of cohort and measure, quiet and loud ones."""
    m = _mentions(spark, folder).select("country", "target_iso3", "entity_scope", "migrant_cohort", "policy_measure")
    known = m.where("migrant_cohort <> 'unspecified' and policy_measure <> 'unspecified'")
    cells = known.groupBy("country", F.concat_ws(" / ", "migrant_cohort", "policy_measure").alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    cross = m.where("entity_scope = 'country' and target_iso3 is not null").groupBy("country", "target_iso3").agg(_n())
    return X.policy_pairs(cells, cross, 20, 10, least_cross=5)


def m21_coordinates(spark, folder):
    return X.coordinate_table(dyads.e33_contingency(spark, folder), "country", "target_iso3")


def c11_agenda(spark, folder):
    """Directions of the agenda per target, with their shares."""
    d = F.col("migration_direction")
    agenda = F.when(d == "inbound_internal", "internal_inbound").when(d == "outbound_from_domestic", "domestic_outbound").when(d == "external_transnational", d).otherwise("ambiguous")
    counts = _mentions(spark, folder).where("entity_name is not null").groupBy("entity_name", agenda.alias("agenda_direction")).agg(_n())
    return P.with_percent(counts, ["entity_name"])


def d6_normalized(spark, folder):
    """Directed pairs against mentions and speeches of both sides."""
    speeches = table(spark, folder, "facts", "country", "speech_id").groupBy("country").agg(F.count_distinct("speech_id").alias("units"))
    return D.normalized_asymmetry(dyads._resolved(spark, folder).select("country", "target_iso3"), speeches)


def e27_scored_attention(spark, folder):
    return D.yearly_attention(_mentions(spark, folder).where("target_iso3 is not null"), "concreteness_score")


def e34_country_crosstab(spark, folder):
    return P.pivot_counts(_mentions(spark, folder), "country", "argument_scheme", ["conceptual_definition", "argument_from_consequences", "practical_reasoning", "other"])


def e38_rows_per_year(spark, folder):
    return table(spark, folder, "facts", "session_date").groupBy(F.year("session_date").alias("session_year")).agg(_n())


def e38_target_agency(spark, folder):
    """Weights of the agency edges by target and agency."""
    return annotated.e14_agency_edges(spark, folder).groupBy("entity_name", "policy_agency").agg(F.sum("weight").alias("weight"))


def g4_definitions(spark, folder):
    """Definitions of migration, with the text around them."""
    return _mentions(spark, folder).where("argument_scheme = 'conceptual_definition'").select("fact_id", "definition_snippet")


def g11_prompt_texts(spark, folder):
    return _mentions(spark, folder).select("fact_id", A.prompt_text(F.col("entity_name"), F.col("country"), F.col("context_window")).alias("prompt_text"))


def g12_provenance(spark, folder):
    """How the labels of the mentions were made."""
    return _mentions(spark, folder).groupBy("diffusion_method", "framing_method", "direction_method", "concreteness_method").agg(_n())


def i6_event_table(spark, folder):
    """The concrete mentions as a table to read."""
    m = _mentions(spark, folder).where("concreteness_score >= 3.3")
    fact = F.when(F.col("session_date").isNotNull(), 5.0).otherwise(F.col("concreteness_score"))
    return m.select("source_year", "session_date", "entity_name", "target_iso3", "concreteness_score", fact.alias("fact_score"), "narrative_frame", "policy_agency", "migrant_cohort", "policy_measure", "migration_direction", F.substring(T.compact(F.col("context_window")), 1, 900).alias("excerpt"), "sentence_id", "fact_id")


def i3_event_anchors(spark, folder):
    """Names in the texts of concrete mentions, the countries among them with their codes, and a label for the event."""
    names = table(spark, folder, "country_list").where("country_name <> ''").groupBy("country_name").agg(F.min("iso3").alias("iso3")).orderBy("country_name").limit(reports.MOST_NAMES + 1).collect()
    if len(names) > reports.MOST_NAMES:
        raise ValueError(f"the list of names has more than {reports.MOST_NAMES} entries")
    events = A.concrete_events(_mentions(spark, folder))
    found = F.array_distinct(A.named_countries(F.col("context_window"), [r["country_name"] for r in names]))
    codes = F.array_distinct(F.transform(found, lambda x: T.lookup(x, {r["country_name"]: r["iso3"] for r in names}, "")))
    label = F.when(F.col("event_anchors") != "", F.col("event_anchors")).otherwise(F.col("entity_name"))
    return events.select("fact_id", "event_anchors", F.array_join(found, ", ").alias("countries"), F.array_join(codes, ", ").alias("codes"), label.alias("event_label"))


def e17_visible_anchors(spark, folder):
    """Per target: concrete mentions and the different names seen with them."""
    return P.profile(A.concrete_events(_mentions(spark, folder)), ["entity_name", "target_iso3", "weog_group"], ["narrative_frame", "policy_agency"], ["event_anchors"], means={"concreteness_score": 3})


def n2_prompts(spark, folder):
    """A prompt per parliament: evidence of its mentions in the order of the sample."""
    evidence = N.prompt_evidence(table(spark, folder, "facts"), "country", "fact_id", 5)
    return N.prompts(evidence, TEMPLATE, ["country", "n_snippets", "evidence"]).select("country", "prompt")


def n3_checked_answers(spark, folder):
    """How often answers of each task have a fault in a field."""
    found = N.checked(table(spark, folder, "task_runs"), "line_id", "task", "body")
    return found.select("task", F.explode("faults").alias("fault")).groupBy("task", "fault").agg(_n())


def v3_asymmetry_bars(spark, folder):
    """The 30 most asymmetric pairs, labelled, in the order of the bars."""
    pairs = D.asymmetry(dyads._matrix(spark, folder)).withColumn("size", F.round(F.abs("log_ratio"), 9))
    top = pairs.orderBy(F.desc("size"), F.desc("total"), "a", "b").limit(30)
    return top.select(F.concat("a", F.lit(" → "), "b").alias("pair"), "log_ratio", "total", F.when(F.col("log_ratio") > 0, F.concat("a", F.lit(" names more"))).otherwise(F.concat("b", F.lit(" names more"))).alias("direction"))


def v3_shock_deltas(spark, folder):
    """Changes of attention after a shock of at least 2 mentions."""
    deltas = D.shock_window(dyads._resolved(spark, folder), SHOCK, 90).where(F.abs("delta_n") >= 2)
    return deltas.select(F.concat("country", F.lit(" → "), "target_iso3").alias("label"), "delta_n")


def v7_treemap(spark, folder):
    """The 180 most frequent combinations of target, frame and measure of concrete European mentions."""
    m = _mentions(spark, folder).where((F.col("concreteness_score") >= 3.3) & (F.col("region_group") == "european_country"))
    return P.profile(m, ["entity_name", "narrative_frame", "policy_measure"], ["policy_agency"]).orderBy(F.desc("n"), "entity_name", "narrative_frame", "policy_measure").limit(180)


def v7_network(spark, folder):
    """Edges of the network of sources and targets with at least 3 mentions, with the usual agency."""
    return P.profile(_mentions(spark, folder), ["country", "entity_name"], ["policy_agency"]).where("n >= 3")


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and n[1:2].isdigit()}

_COMPACT = r"trim(regexp_replace(replace(context_window, '||', ' '), '\s+', ' ', 'g'))"
_SCORE, _SENT = "avg(cast(round(concreteness_score * 1000) AS bigint)) / 1000", "avg(cast(round(sentence_sentiment_value * 10000) AS bigint)) / 10000"
_FEATURES = _W + f""", prof AS (
  SELECT country, ln(1 + count(*)) AS log_mentions, ln(1 + count(DISTINCT speech_id)) AS log_speeches, ln(1 + count(DISTINCT speaker_id)) AS log_speakers, cast(count(DISTINCT entity_name) AS double) AS n_targets,
    coalesce({_SCORE}, 0.0) AS mean_concreteness_score, coalesce({_SENT}, 0.0) AS mean_sentence_sentiment_value FROM mentions GROUP BY 1),
tot AS (SELECT country, count(*) AS t FROM mentions GROUP BY 1),
top25 AS (SELECT entity_name FROM mentions GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 25),
long AS (UNPIVOT prof ON log_mentions, log_speeches, log_speakers, n_targets, mean_concreteness_score, mean_sentence_sentiment_value INTO NAME feature VALUE value),
cells AS ({" UNION ALL ".join(f"SELECT country, '{c}=' || {c} AS feature, count(*) AS n FROM mentions WHERE {c} IS NOT NULL GROUP BY 1, 2" for c in LEVELS)}
  UNION ALL SELECT country, 'entity_name=' || entity_name, count(*) FROM mentions WHERE entity_name IN (SELECT entity_name FROM top25) GROUP BY 1, 2),
present AS (SELECT country, feature, value FROM long UNION ALL SELECT country, feature, n / t FROM cells JOIN tot USING (country)),
features AS (SELECT c.country, f.feature, coalesce(p.value, 0.0) AS value FROM (SELECT DISTINCT country FROM present) c CROSS JOIN (SELECT DISTINCT feature FROM present) f LEFT JOIN present p ON p.country = c.country AND p.feature = f.feature),
stats AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM features GROUP BY 1),
z AS (SELECT country, feature, greatest(-2.5, least(2.5, CASE WHEN s = 0 THEN 0.0 ELSE (value - m) / s END)) AS z FROM features JOIN stats USING (feature)),
norms AS (SELECT country, CASE WHEN sum(z * z) = 0 THEN 1.0 ELSE sqrt(sum(z * z)) END AS n FROM z GROUP BY 1),
cosines AS (SELECT x.country AS a, y.country AS b, round(greatest(-1.0, least(1.0, sum(x.z * y.z) / (min(nx.n) * min(ny.n)))), 6) AS similarity
  FROM z x JOIN z y ON x.feature = y.feature AND x.country < y.country JOIN norms nx ON nx.country = x.country JOIN norms ny ON ny.country = y.country GROUP BY 1, 2)"""
_SNIP = "'prev: ' || substring(coalesce(sentence_content_previous, ''), 1, 300) || ' | cur: ' || substring(sentence_content_current, 1, 300) || ' | next: ' || substring(coalesce(sentence_content_next, ''), 1, 300)"
_HASH = "md5(cast(fact_id AS varchar) || '42')"

ORACLE = {
    "m6_features": _FEATURES + " SELECT * FROM features",
    "m7_zscores": _FEATURES + " SELECT country, feature, round(z, 6) AS z FROM z",
    "m8_cosine": _FEATURES + " SELECT * FROM cosines",
    "m9_extremes": _FEATURES + " (SELECT *, 'closest' AS kind FROM cosines ORDER BY similarity DESC, a, b LIMIT 8) UNION ALL (SELECT *, 'divergent' FROM cosines ORDER BY similarity, a, b LIMIT 8)",
    "m10_signatures": _FEATURES + """, r AS (SELECT country, feature, row_number() OVER (PARTITION BY country ORDER BY round(z, 9) DESC, feature) AS i FROM z WHERE round(z, 9) > 0 AND feature NOT IN ('log_mentions', 'log_speeches', 'log_speakers', 'n_targets'))
        SELECT country, string_agg(feature, ', ' ORDER BY i) AS signature FROM r WHERE i <= 4 GROUP BY 1""",
    "m17_convergence_pairs": _W + """, c AS (SELECT country, migrant_cohort || ' / ' || policy_measure AS feature, count(*) AS v FROM mentions WHERE migrant_cohort <> 'unspecified' AND policy_measure <> 'unspecified' GROUP BY 1, 2),
        u AS (SELECT country, feature, v / sqrt(sum(v * v) OVER (PARTITION BY country)) AS u FROM c),
        s AS (SELECT x.country AS a, y.country AS b, x.feature, round(x.u * y.u, 9) AS part FROM u x JOIN u y ON x.feature = y.feature AND x.country < y.country),
        r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY part DESC, feature) AS i FROM s),
        k AS (SELECT country, target_iso3, count(*) AS n FROM mentions WHERE entity_scope = 'country' AND target_iso3 IS NOT NULL GROUP BY 1, 2),
        p AS (SELECT a, b, round(sum(part), 6) AS similarity, string_agg(feature, '; ' ORDER BY i) FILTER (i <= 3) AS shared_cells FROM r GROUP BY 1, 2),
        q AS (SELECT p.*, coalesce(f.n, 0) AS n_ab, coalesce(g.n, 0) AS n_ba, coalesce(f.n, 0) + coalesce(g.n, 0) AS cross_total FROM p LEFT JOIN k f ON f.country = a AND f.target_iso3 = b LEFT JOIN k g ON g.country = b AND g.target_iso3 = a)
        SELECT * FROM (SELECT * FROM q ORDER BY similarity DESC, a, b LIMIT 20) UNION SELECT * FROM (SELECT * FROM q WHERE similarity >= 0.5 AND cross_total >= 5 ORDER BY cross_total DESC, a, b LIMIT 10)""",
    "c11_agenda": _W + """, c AS (SELECT entity_name, CASE migration_direction WHEN 'inbound_internal' THEN 'internal_inbound' WHEN 'outbound_from_domestic' THEN 'domestic_outbound' WHEN 'external_transnational' THEN 'external_transnational' ELSE 'ambiguous' END AS agenda_direction, count(*) AS n FROM mentions WHERE entity_name IS NOT NULL GROUP BY 1, 2)
        SELECT *, n * 100.0 / sum(n) OVER (PARTITION BY entity_name) AS percent FROM c""",
    "d6_normalized": _R + """, c AS (SELECT country, target_iso3, count(*) AS n FROM resolved GROUP BY 1, 2), t AS (SELECT country, sum(n) AS t FROM c GROUP BY 1), u AS (SELECT country, count(DISTINCT speech_id) AS u FROM facts GROUP BY 1),
        p AS (SELECT c.country, c.target_iso3, c.n, cast(t.t AS bigint) AS n_source, coalesce(u.u, 1) AS source_units, cast(coalesce(o.t, 0) AS bigint) AS n_target, coalesce(w.u, 1) AS target_units, coalesce(b.n, 0) AS n_reverse
          FROM c JOIN t ON t.country = c.country LEFT JOIN u ON u.country = c.country LEFT JOIN t o ON o.country = c.target_iso3 LEFT JOIN u w ON w.country = c.target_iso3 LEFT JOIN c b ON b.country = c.target_iso3 AND b.target_iso3 = c.country WHERE c.n >= 10)
        SELECT *, n * 1000 / source_units AS rate_per_1000_units, n * 1000 / n_source AS rate_per_1000_mentions, n + n_reverse AS total, n / (n_reverse + 1) AS raw_ratio,
          ((n + 0.5) / source_units) / ((n_reverse + 0.5) / target_units) AS normalized_ratio, ln((n + 0.5) / source_units) - ln((n_reverse + 0.5) / target_units) AS normalized_log_ratio FROM p""",
    "e27_scored_attention": _W + f""", m AS (SELECT * FROM mentions WHERE target_iso3 IS NOT NULL)
        SELECT country, target_iso3, source_year, CASE WHEN target_iso3 IN (SELECT country FROM m) THEN 'reciprocal_asymmetry_candidate' ELSE 'external_target' END AS analysis_scope,
        count(*) AS n_mentions, count(DISTINCT speech_id) AS n_speeches, count(DISTINCT speaker_id) AS n_speakers, {_SENT} AS mean_sentiment, {_SCORE} AS mean_concreteness FROM m GROUP BY 1, 2, 3, 4""",
    "e34_country_crosstab": _W + " SELECT country, " + ", ".join(f"count(*) FILTER (argument_scheme = '{x}') AS {x}" for x in ("conceptual_definition", "argument_from_consequences", "practical_reasoning", "other")) + " FROM mentions GROUP BY 1",
    "e38_rows_per_year": "SELECT cast(year(session_date) AS int) AS session_year, count(*) AS n FROM facts GROUP BY 1",
    "e38_target_agency": _W + " SELECT entity_name, policy_agency, count(*) AS weight FROM mentions GROUP BY 1, 2",
    "g4_definitions": _W + rf""", d AS (SELECT fact_id, context_window AS w, regexp_extract(lower(context_window), {S.quoted(rf"\b({S.vocab.DEFINED})\s+({S.vocab.DEFINES})\b")}) AS f, string_split_regex(lower(context_window), {S.quoted(rf"\b({S.vocab.DEFINED})\s+({S.vocab.DEFINES})\b")})[1] AS b FROM mentions WHERE argument_scheme = 'conceptual_definition')
        SELECT fact_id, trim(regexp_replace(replace(substring(w, greatest(1, len(b) - 79), len(b) + 1 + len(f) + 220 - greatest(1, len(b) - 79)), '||', ' '), '\s+', ' ', 'g')) AS definition_snippet FROM d""",
    "g11_prompt_texts": _W + ", c AS (SELECT *, " + _COMPACT + " AS short FROM mentions) SELECT fact_id, 'Source: ' || country || chr(10) || 'Target: ' || entity_name || chr(10) || 'Text: ' || CASE WHEN len(short) > 900 THEN rtrim(substring(short, 1, 897)) || '...' ELSE short END AS prompt_text FROM c",
    "g12_provenance": _W + " SELECT 'keyword_rules' AS diffusion_method, 'keyword_rules' AS framing_method, 'surface_rules' AS direction_method, 'fallback_rules' AS concreteness_method, count(*) AS n FROM mentions",
    "i6_event_table": _W + f" SELECT source_year, session_date, entity_name, target_iso3, concreteness_score, CASE WHEN session_date IS NOT NULL THEN 5.0 ELSE concreteness_score END AS fact_score, narrative_frame, policy_agency, migrant_cohort, policy_measure, migration_direction, substring({_COMPACT}, 1, 900) AS excerpt, sentence_id, fact_id FROM mentions WHERE concreteness_score >= 3.3",
    "n2_prompts": f"""WITH s AS (SELECT * FROM facts WHERE sentence_content_current IS NOT NULL QUALIFY row_number() OVER (PARTITION BY country ORDER BY {_HASH}, fact_id) <= 5)
        SELECT country, 'Parliament: ' || country || chr(10) || 'Mentions of ' || count(*) || chr(10) || chr(10) || string_agg({_SNIP}, chr(10) ORDER BY {_HASH}, fact_id) || chr(10) || chr(10) || 'Answer with one JSON object.' AS prompt FROM s GROUP BY 1""",
    "v3_asymmetry_bars": _M + """, p AS (SELECT x.country AS a, x.target_iso3 AS b, ln((x.n_mentions + 1) / (y.n_mentions + 1)) AS log_ratio, x.n_mentions + y.n_mentions AS total FROM matrix x JOIN matrix y ON x.country = y.target_iso3 AND x.target_iso3 = y.country WHERE x.country < x.target_iso3)
        SELECT a || ' → ' || b AS pair, log_ratio, total, CASE WHEN log_ratio > 0 THEN a ELSE b END || ' names more' AS direction FROM p ORDER BY round(abs(log_ratio), 9) DESC, total DESC, a, b LIMIT 30""",
    "v3_shock_deltas": _R + f""", d AS (SELECT country, target_iso3, count(*) FILTER (session_date >= date '{SHOCK}') - count(*) FILTER (session_date < date '{SHOCK}') AS delta_n FROM resolved WHERE session_date BETWEEN date '{SHOCK}' - 90 AND date '{SHOCK}' + 90 GROUP BY 1, 2)
        SELECT country || ' → ' || target_iso3 AS label, delta_n FROM d WHERE abs(delta_n) >= 2""",
    "v7_treemap": _W + ", v AS (SELECT * FROM mentions WHERE concreteness_score >= 3.3 AND region_group = 'european_country'), g AS (SELECT entity_name, narrative_frame, policy_measure, count(*) AS n FROM v GROUP BY 1, 2, 3) SELECT g.*, " + _DOM(["policy_agency"]) + " FROM g" + _MODE("entity_name, narrative_frame, policy_measure", ["policy_agency"], "v") + " ORDER BY n DESC, g.entity_name, g.narrative_frame, g.policy_measure LIMIT 180",
    "v7_network": _W + ", g AS (SELECT country, entity_name, count(*) AS n FROM mentions GROUP BY 1, 2 HAVING count(*) >= 3) SELECT g.*, " + _DOM(["policy_agency"]) + " FROM g" + _MODE("country, entity_name", ["policy_agency"]),
}
