"""Queries of the dyadic track over the fact table: who speaks about whom."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenarium.functions import text as T
from plenarium.functions import vocab
from plenarium.operators import dyadic as D
from plenarium.operators import matrix as X
from plenarium.operators import mentions as M
from plenarium.operators import profiles as P
from plenarium.plans import sqltext as S
from plenarium.sources.tables import table

SHOCK = vocab.SHOCKS["ukraine_war"]


def _resolved(spark: SparkSession, folder: str) -> DataFrame:
    return D.topic_resolved(table(spark, folder, "facts"), table(spark, folder, "country_list"))


def _matrix(spark: SparkSession, folder: str) -> DataFrame:
    return D.bilateral_matrix(_resolved(spark, folder))


def d0_resolver(spark, folder):
    return M.resolver(table(spark, folder, "country_list"))


def d1_resolved(spark, folder):
    return M.resolve(table(spark, folder, "facts"), table(spark, folder, "country_list")).select("fact_id", "target_iso3", "target_name", "confidence")


def e9_topic_speeches(spark, folder):
    return M.topic_speeches(table(spark, folder, "facts"))


def d2_topic_mentions(spark, folder):
    return _resolved(spark, folder).select("fact_id", "country", "target_iso3")


def e7_bilateral_matrix(spark, folder):
    return _matrix(spark, folder)


def e10_sentence_counts(spark, folder):
    return D.per_sentence_counts(table(spark, folder, "facts"))


def h5_grounded_mentions(spark, folder):
    return D.grounded_mentions(_resolved(spark, folder), table(spark, folder, "facts")).select("fact_id", "target_iso3", "n_per", "n_loc", "n_org", "n_numbers", "n_years", "n_tokens", "grounded_score")


def e8_bilateral_concreteness(spark, folder):
    return D.bilateral_concreteness(D.grounded_mentions(_resolved(spark, folder), table(spark, folder, "facts")))


def e12_asymmetry(spark, folder):
    return D.asymmetry(_matrix(spark, folder))


def d5_directed_ratio(spark, folder):
    return D.directed_ratio(_matrix(spark, folder))


def m18_smoothed_asymmetry(spark, folder):
    return D.smoothed_asymmetry(_matrix(spark, folder))


def e11_shock_window(spark, folder):
    return D.shock_window(_resolved(spark, folder), SHOCK, 90)


def e27_yearly_attention(spark, folder):
    return D.yearly_attention(_resolved(spark, folder))


def e28_yearly_total(spark, folder):
    return D.yearly_total(table(spark, folder, "task9_ukraine_yearly_attention", "country", "source_year", "n_mentions"))


def e29_salience(spark, folder):
    return D.salience(D.yearly_attention(_resolved(spark, folder)), 5)


def d13_zero_filled(spark, folder):
    counts = table(spark, folder, "facts").where("entity_category is not null").groupBy("country", "entity_category").agg(F.count(F.lit(1)).alias("n"))
    return D.zero_filled(counts, "country", "entity_category", "n")


def m2_share_matrix(spark, folder):
    counts = _resolved(spark, folder).groupBy("country", "target_iso3").agg(F.count(F.lit(1)).alias("n"))
    return X.shares(counts, "country", "target_iso3", "n", X.top_columns(counts, "target_iso3", "n", 25))


def m4_masked_means(spark, folder):
    return X.masked_means(_resolved(spark, folder), "country", "target_iso3", "sentence_sentiment_value")


def m5_profile_features(spark, folder):
    return X.profile_features(_resolved(spark, folder), "country", "target_iso3", "sentence_sentiment_value")


def m11_lift(spark, folder):
    return X.lift(_resolved(spark, folder), "country", "target_iso3", 20)


def e33_contingency(spark, folder):
    return X.contingency(_resolved(spark, folder), "country", "target_iso3", 20, 10, 35)


def m15_residuals(spark, folder):
    return X.residuals(e33_contingency(spark, folder), "country", "target_iso3")


def m16_top_residuals(spark, folder):
    return X.top_residuals(m15_residuals(spark, folder).withColumn("residual", F.round("residual", 9)), "country", "target_iso3")


def m14_correspondence(spark, folder):
    return X.correspondence(e33_contingency(spark, folder), "country", "target_iso3")


def m1_pagerank(spark, folder):
    edges = _resolved(spark, folder).groupBy(F.col("country").alias("source"), F.col("target_iso3").alias("target")).agg(F.count(F.lit(1)).alias("weight"))
    return X.pagerank(edges)


def e25_trend(spark, folder):
    counts = _resolved(spark, folder).groupBy("country", F.year("session_date").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return P.trend(counts, "country", "year", "n")


def b8_shock_days(spark, folder):
    """All named shocks at once: mentions per shock, period and target."""
    days = spark.createDataFrame(list(vocab.SHOCKS.items()), "shock string, day string").select("shock", F.to_date("day").alias("day"))
    r = _resolved(spark, folder).select("session_date", "target_iso3")
    near = r.join(F.broadcast(days), F.col("session_date").between(F.date_sub("day", 90), F.date_add("day", 90)))
    return near.groupBy("shock", F.when(F.col("session_date") < F.col("day"), "pre").otherwise("post").alias("period"), "target_iso3").agg(F.count(F.lit(1)).alias("n"))


def f8_speaker_join(spark, folder):
    """Mentions per gender of the speaker, joined on the letters and digits of the identifier."""
    people = table(spark, folder, "people", "speaker_id", "gender").select(T.bare_id(F.col("speaker_id")).alias("person"), "gender")
    facts = table(spark, folder, "facts", "speaker_id").where("speaker_id is not null").select(F.upper(T.bare_id(F.col("speaker_id"))).alias("person"))
    counts = facts.groupBy("person").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(people, "person").groupBy("gender").agg(F.sum("n").alias("n_mentions"))


def _spells(spark, folder):
    """Every order as a spell of 90 days of its customer."""
    day = F.to_date("o_orderdate")
    return table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate").select(F.col("o_custkey").alias("person"), day.alias("start"), F.date_add(day, 90).alias("stop"), "o_orderkey")


def _shipped(spark, folder):
    """Every line with its day of shipping and the customer of its order (null where the order is missing)."""
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.col("l_orderkey").alias("o_orderkey"), F.to_date("l_shipdate").alias("day"))
    owners = table(spark, folder, "orders", "o_orderkey", "o_custkey").withColumnRenamed("o_custkey", "person")
    return lines.join(owners, "o_orderkey", "left").select("line", "person", "day")


def d8_best_valid(spark, folder):
    """Each line with the latest order of its customer that was placed at most 90 days before (validity as an interval)."""
    return D.best_valid(_shipped(spark, folder), _spells(spark, folder), ["person"], "day", "start", "stop", ["o_orderkey"]).select("line", "o_orderkey")


def d9_all_valid(spark, folder):
    """Each line with every order of its customer that was placed at most 90 days before."""
    return D.all_valid(_shipped(spark, folder), _spells(spark, folder), ["person"], "day", "start", "stop").select("line", "o_orderkey")


QUERIES = {n: f for n, f in list(globals().items()) if n[0] != "_" and n[1:2].isdigit() and callable(f)}

_R = f"WITH {S.RESOLVED}"
_M = _R + f""", matrix AS (
  SELECT r.country, r.target_iso3, count(*) AS n_mentions, count(DISTINCT speech_id) AS n_speeches, count(DISTINCT speaker_id) AS n_speakers,
    avg(cast(round(sentence_sentiment_value * 10000) AS bigint)) / 10000 AS mean_sentiment, stddev_samp(sentence_sentiment_value) AS sd_sentiment, min(m.target_name) AS target_name
  FROM resolved r LEFT JOIN {S.mode("country, target_iso3", "target_name", "resolved", "target_name")} m ON r.country = m.country AND r.target_iso3 = m.target_iso3
  GROUP BY 1, 2)"""
_G = _R + """, per AS (
  SELECT sentence_id, count(*) FILTER (entity_category = 'PER') AS n_per, count(*) FILTER (entity_category = 'LOC') AS n_loc, count(*) FILTER (entity_category = 'ORG') AS n_org FROM facts GROUP BY 1),
wind AS (SELECT *, """ + S.THREE + r""" AS w FROM resolved),
counted AS (SELECT *, len(regexp_extract_all(w, '\b\d+([.,]\d+)?\b')) AS n_numbers, len(regexp_extract_all(w, '\b(19|20)\d{2}\b')) AS n_years, len(string_split(w, ' ')) AS n_tokens FROM wind),
grounded AS (SELECT c.*, n_per, n_loc, n_org, (n_per + n_loc + n_org + n_numbers + n_years) * 1000.0 / greatest(n_tokens, 1) AS grounded_score FROM counted c LEFT JOIN per USING (sentence_id))"""
_A = _R + """, attention AS (
  SELECT country, target_iso3, cast(year(session_date) AS int) AS source_year, CASE WHEN target_iso3 IN (SELECT country FROM resolved) THEN 'reciprocal_asymmetry_candidate' ELSE 'external_target' END AS analysis_scope,
    count(*) AS n_mentions, count(DISTINCT speech_id) AS n_speeches, count(DISTINCT speaker_id) AS n_speakers, avg(cast(round(sentence_sentiment_value * 10000) AS bigint)) / 10000 AS mean_sentiment
  FROM resolved GROUP BY 1, 2, 3, 4)"""
_RATIO = _M + """, ratio AS (
  SELECT f.country AS source, f.target_iso3 AS target, f.n_mentions AS n_forward, coalesce(b.n_mentions, 0) AS n_reverse, f.n_mentions / (coalesce(b.n_mentions, 0) + 1) AS ratio
  FROM matrix f LEFT JOIN matrix b ON f.country = b.target_iso3 AND f.target_iso3 = b.country)"""
_COUNTS = _R + ", counts AS (SELECT country, target_iso3, count(*) AS n FROM resolved GROUP BY 1, 2)"
_CONT = _COUNTS + """, rows1 AS (SELECT country FROM counts GROUP BY 1 HAVING sum(n) >= 20), kept AS (SELECT * FROM counts WHERE country IN (SELECT country FROM rows1)),
cols1 AS (SELECT target_iso3 FROM kept GROUP BY 1 HAVING sum(n) >= 10 ORDER BY sum(n) DESC, target_iso3 LIMIT 35), cont AS (SELECT * FROM kept WHERE target_iso3 IN (SELECT target_iso3 FROM cols1)),
res AS (SELECT *, sum(n) OVER (PARTITION BY country) * sum(n) OVER (PARTITION BY target_iso3) / sum(n) OVER () AS expected FROM cont),
resid AS (SELECT *, (n - expected) / sqrt(expected) AS residual FROM res)"""
_SPELLS = """
WITH ev AS (SELECT l_orderkey * 10 + l_linenumber AS line, o_custkey AS person, cast(l_shipdate AS date) AS day FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey),
sp AS (SELECT o_custkey AS person, cast(o_orderdate AS date) AS start, cast(o_orderdate AS date) + 90 AS stop, o_orderkey FROM orders)"""

ORACLE = {
    "d0_resolver": _R + " SELECT * FROM resolver",
    "d1_resolved": _R + f" SELECT fact_id, target_iso3, target_name, confidence FROM facts JOIN resolver ON {S.NORMAL.format('entity_content')} = alias_normal WHERE entity_category IN ('LOC', 'ORG', 'MISC') AND target_iso3 <> country AND confidence >= 0.85",
    "e9_topic_speeches": _R + " SELECT * FROM speeches",
    "d2_topic_mentions": _R + " SELECT fact_id, country, target_iso3 FROM resolved",
    "e7_bilateral_matrix": _M + " SELECT * FROM matrix",
    "e10_sentence_counts": _G + " SELECT * FROM per",
    "h5_grounded_mentions": _G + " SELECT fact_id, target_iso3, n_per, n_loc, n_org, n_numbers, n_years, n_tokens, grounded_score FROM grounded",
    "e8_bilateral_concreteness": _G + " SELECT country, target_iso3, count(*) AS n_mentions, avg(grounded_score) AS mean_score, median(grounded_score) AS median_score, stddev_samp(grounded_score) AS sd_score, count(DISTINCT speech_id) AS n_speeches FROM grounded GROUP BY 1, 2",
    "e12_asymmetry": _M + """ SELECT x.country AS a, x.target_iso3 AS b, x.n_mentions AS n_ab, y.n_mentions AS n_ba, x.n_mentions / (x.n_mentions + y.n_mentions) AS share_ab,
        ln((x.n_mentions + 1) / (y.n_mentions + 1)) AS log_ratio, x.mean_sentiment - y.mean_sentiment AS sentiment_gap, x.n_mentions + y.n_mentions AS total
        FROM matrix x JOIN matrix y ON x.country = y.target_iso3 AND x.target_iso3 = y.country WHERE x.country < x.target_iso3""",
    "d5_directed_ratio": _RATIO + " SELECT * FROM ratio",
    "m18_smoothed_asymmetry": _RATIO + """, t AS (SELECT country, cast(sum(n_mentions) AS bigint) AS n FROM matrix GROUP BY 1)
        SELECT source, target, n_forward, n_reverse, s.n AS n_source, coalesce(o.n, 0) AS n_target, (n_forward + 0.5) * 1000.0 / (s.n + 1) AS rate_forward, (n_reverse + 0.5) * 1000.0 / (coalesce(o.n, 0) + 1) AS rate_reverse,
        ln(((n_forward + 0.5) * 1000.0 / (s.n + 1)) / ((n_reverse + 0.5) * 1000.0 / (coalesce(o.n, 0) + 1))) AS log_ratio
        FROM ratio JOIN t s ON s.country = source LEFT JOIN t o ON o.country = target""",
    "e11_shock_window": _R + f""", w AS (SELECT *, session_date < date '{SHOCK}' AS pre FROM resolved WHERE session_date BETWEEN date '{SHOCK}' - 90 AND date '{SHOCK}' + 90),
        s AS (SELECT country, target_iso3, count(*) FILTER (pre) AS n_pre, count(*) FILTER (NOT pre) AS n_post, avg(cast(round(sentence_sentiment_value * 10000) AS bigint)) FILTER (pre) / 10000 AS sentiment_pre, avg(cast(round(sentence_sentiment_value * 10000) AS bigint)) FILTER (NOT pre) / 10000 AS sentiment_post FROM w GROUP BY 1, 2)
        SELECT *, n_post - n_pre AS delta_n, sentiment_post - sentiment_pre AS delta_sentiment FROM s""",
    "e27_yearly_attention": _A + " SELECT * FROM attention",
    "e28_yearly_total": "SELECT source_year, cast(sum(n_mentions) AS bigint) AS total_mentions, count(DISTINCT country) AS n_source_parliaments FROM task9_ukraine_yearly_attention GROUP BY 1",
    "e29_salience": _A + " SELECT country, target_iso3, analysis_scope, cast(sum(n_mentions) AS bigint) AS n_mentions, min(source_year) AS first_year, max(source_year) AS last_year FROM attention GROUP BY 1, 2, 3 HAVING sum(n_mentions) >= 5",
    "d13_zero_filled": """WITH c AS (SELECT country, entity_category, count(*) AS n FROM facts WHERE entity_category IS NOT NULL GROUP BY 1, 2)
        SELECT r.country, k.entity_category, coalesce(n, 0) AS n FROM (SELECT DISTINCT country FROM c) r CROSS JOIN (SELECT DISTINCT entity_category FROM c) k LEFT JOIN c ON c.country = r.country AND c.entity_category = k.entity_category""",
    "m2_share_matrix": _COUNTS + ", top AS (SELECT target_iso3 FROM counts GROUP BY 1 ORDER BY sum(n) DESC, 1 LIMIT 25), s AS (SELECT *, n / sum(n) OVER (PARTITION BY country) AS share FROM counts) SELECT * FROM s WHERE target_iso3 IN (SELECT target_iso3 FROM top)",
    "m4_masked_means": _R + " SELECT country, target_iso3, count(*) AS n, CASE WHEN count(*) >= 20 THEN avg(cast(round(sentence_sentiment_value * 10000) AS bigint)) / 10000 END AS mean_value FROM resolved GROUP BY 1, 2",
    "m5_profile_features": _R + """, prof AS (
        SELECT country, ln(1 + count(*)) AS log_mentions, ln(1 + count(DISTINCT speech_id)) AS log_speeches, ln(1 + count(DISTINCT speaker_id)) AS log_speakers,
          cast(count(DISTINCT target_iso3) AS double) AS n_targets, avg(cast(round(sentence_sentiment_value * 10000) AS bigint)) / 10000 AS mean_sentiment FROM resolved GROUP BY 1)
        SELECT * FROM (UNPIVOT prof ON log_mentions, log_speeches, log_speakers, n_targets, mean_sentiment INTO NAME feature VALUE value)""",
    "m11_lift": _COUNTS + ", s AS (SELECT *, n / sum(n) OVER (PARTITION BY country) AS share, sum(n) OVER (PARTITION BY target_iso3) / sum(n) OVER () AS corpus_share FROM counts) SELECT *, share / corpus_share AS lift FROM s WHERE n >= 20",
    "e33_contingency": _CONT + " SELECT * FROM cont",
    "m15_residuals": _CONT + " SELECT * FROM resid",
    "m16_top_residuals": _CONT + ", r AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY round(residual, 9) DESC, target_iso3) AS i FROM resid WHERE round(residual, 9) > 0) SELECT country, string_agg(target_iso3, ', ' ORDER BY i) AS top_residuals FROM r WHERE i <= 3 GROUP BY 1",
    "e25_trend": _R + """, y AS (SELECT country, cast(year(session_date) AS int) AS year, count(*) AS n FROM resolved GROUP BY 1, 2)
        SELECT country, min(year) AS first_year, max(year) AS last_year, arg_min(n, year) AS first_value, arg_max(n, year) AS last_value,
        arg_min(year, {'m': -n, 'y': year}) AS peak_year, max(n) AS peak_value, arg_max(n, year) - arg_min(n, year) AS delta FROM y GROUP BY 1""",
    "b8_shock_days": _R + f""", d(shock, day) AS (VALUES {", ".join(f"('{k}', date '{v}')" for k, v in vocab.SHOCKS.items())})
        SELECT shock, CASE WHEN session_date < day THEN 'pre' ELSE 'post' END AS period, target_iso3, count(*) AS n FROM resolved JOIN d ON session_date BETWEEN day - 90 AND day + 90 GROUP BY 1, 2, 3""",
    "f8_speaker_join": "SELECT gender, count(*) AS n_mentions FROM facts f JOIN people p ON upper(regexp_replace(f.speaker_id, '[^A-Za-z0-9]', '', 'g')) = regexp_replace(p.speaker_id, '[^A-Za-z0-9]', '', 'g') GROUP BY 1",
    "d8_best_valid": _SPELLS + """, j AS (SELECT DISTINCT ev.person, day, o_orderkey, start FROM ev JOIN sp ON ev.person = sp.person AND start <= day AND day <= stop),
        b AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY person, day ORDER BY start DESC, o_orderkey) = 1) SELECT line, o_orderkey FROM ev LEFT JOIN b USING (person, day)""",
    "d9_all_valid": _SPELLS + " SELECT line, o_orderkey FROM (SELECT DISTINCT * FROM ev JOIN sp USING (person) WHERE start <= day AND day <= stop)",
}
