"""Queries of the general data problems (1, 3 and 7) over the engine's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenarium.operators import heavy_keys as hk
from plenarium.operators import packed, schema_drift
from plenarium.sources.tables import table

PACKED = (("task2_extracted_events", "primary_actors"), ("task6_policy_convergence", "evidence_spans"), ("task6_policy_convergence", "shared_focus"))
KEYED = (("facts", "entity_content", "country"), ("task9_ukraine_yearly_attention", "country", "n_mentions"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [table(spark, folder, t, "record_id", f).select(F.lit(t).alias("record_table"), "record_id", F.lit(f).alias("field"), F.col(f).alias("text")) for t, f in PACKED]
    return packed.unpack(reduce(DataFrame.unionAll, parts), [f for _, f in PACKED])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [hk.heavy_keys(hk.compress(table(spark, folder, t, k, v), k, v)).select(F.lit(t).alias("record_table"), F.col("key").alias("key_value")) for t, k, v in KEYED]
    return reduce(DataFrame.unionAll, parts)


def p3_entity_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Per entity: rows, different speaking countries, the country that names it most."""
    weighted = hk.compress(table(spark, folder, "facts", "entity_content", "country"), "entity_content", "country")
    return hk.key_profile(weighted).withColumnRenamed("key", "entity_content")


def p3_country_percentile(spark: SparkSession, folder: str) -> DataFrame:
    """Per country of the yearly attention table: the exact 90th percentile of its mentions."""
    weighted = hk.compress(table(spark, folder, "task9_ukraine_yearly_attention", "country", "n_mentions"), "country", "n_mentions")
    return hk.key_percentile(weighted, 0.9).withColumnRenamed("key", "country")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return schema_drift.drift(table(spark, folder, "task_runs"))


def p7_unified(spark: SparkSession, folder: str) -> DataFrame:
    return schema_drift.unified(table(spark, folder, "task_runs"))


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p3_entity_profile, p3_country_percentile, p7_found, p7_unified)}

ORACLE = {
    "p3_found": """
        SELECT 'facts' AS record_table, entity_content AS key_value FROM facts WHERE entity_content IS NOT NULL
        GROUP BY 2 HAVING count(*) >= 0.03 * (SELECT count(*) FROM facts)
        UNION ALL
        SELECT 'task9_ukraine_yearly_attention', country FROM task9_ukraine_yearly_attention WHERE country IS NOT NULL
        GROUP BY 2 HAVING count(*) >= 0.03 * (SELECT count(*) FROM task9_ukraine_yearly_attention)""",
    "p3_entity_profile": """
        WITH w AS (SELECT entity_content, country, count(*) AS n FROM facts GROUP BY ALL),
        k AS (SELECT entity_content, cast(sum(n) AS bigint) AS n_rows, count(country) AS n_values FROM w GROUP BY 1),
        m AS (SELECT entity_content, country, n FROM w WHERE country IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY entity_content ORDER BY n DESC, country) = 1)
        SELECT k.entity_content, n_rows, n_values, m.country AS mode_value, m.n AS mode_rows
        FROM k LEFT JOIN m ON k.entity_content IS NOT DISTINCT FROM m.entity_content""",
    "p3_country_percentile": """
        WITH r AS (SELECT country, n_mentions, row_number() OVER (PARTITION BY country ORDER BY n_mentions) AS i,
                   count(*) OVER (PARTITION BY country) AS n
                   FROM task9_ukraine_yearly_attention WHERE n_mentions IS NOT NULL)
        SELECT country, n_mentions AS percentile_value FROM r WHERE i = ceil(n * 0.9)""",
}
