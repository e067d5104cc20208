"""Queries of the text and algorithm problems (2, 4, 5, 6, 8, 9 and 10) over the engine's tables."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenarium.llm import canonical, encode, garbled, gazetteer, leakage, topn, truncation
from plenarium.sources.tables import table

CUT = (("task1_asymmetry_drivers", "rationale"), ("task6_policy_convergence", "tension_nature"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.canonical_changes(table(spark, folder, "facts"), "fact_id", "entity_content", "entity_clean")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return topn.top_n(table(spark, folder, "task9_ukraine_yearly_attention"), "country", "n_mentions", "attention_id", 10).select("country", "attention_id")


def _named(spark: SparkSession, folder: str, given: gazetteer.Words = gazetteer.COUNTRY_WORDS) -> DataFrame:
    places = table(spark, folder, "facts", "fact_id", "entity_content", "entity_category").where("entity_category = 'LOC'")
    return gazetteer.match_names(places, "fact_id", "entity_content", table(spark, folder, "country_list"), "iso3", "country_name", "iso3", given)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _named(spark, folder).select("fact_id", "iso3")


def p5_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Names that stand for no country, with the number of rows that hold them."""
    return _named(spark, folder).where(F.col("iso3") == gazetteer.NONE).groupBy("entity_content").agg(F.count(F.lit(1)).alias("n_rows"))


def p5_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """All entries of the list within reach of each different name of a place, with their distances."""
    places = table(spark, folder, "facts", "entity_content", "entity_category").where("entity_category = 'LOC'")
    return gazetteer.candidates(places, "entity_content", table(spark, folder, "country_list"), "iso3", "country_name")


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    parts = [table(spark, folder, t, "record_id", "run_file", f).select(F.lit(t).alias("part"), F.col("record_id").alias("id"), F.col("run_file").alias("source"), F.col(f).alias("text")) for t, f in CUT]
    return reduce(DataFrame.unionAll, parts)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncated(_texts(spark, folder)).select(F.col("part").alias("record_table"), F.col("id").alias("record_id"))


def p6_share(spark: SparkSession, folder: str) -> DataFrame:
    """Per table and run file: records with a text, cut ones, and their share."""
    counts = truncation.verdicts(_texts(spark, folder)).groupBy(F.col("part").alias("record_table"), F.col("source").alias("run_file")).agg(F.count(F.lit(1)).alias("n_texts"), F.count_if("cut").alias("n_cut"))
    return counts.withColumn("share", F.col("n_cut") / F.col("n_texts"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    path = spark.conf.get("plenarium.tokenizer", os.path.join(encode.TOKENIZERS, "byte_bpe_50k.json"))
    return encode.encode_corpus(table(spark, folder, "documents"), "doc_id", "text", path)


def p9_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of words to remove from documents, by leaked item."""
    return leakage.leaked_passages(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "benchmark"), "item_id", "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_spans(spark, folder).select("doc_id", "item_id").distinct()


def p10_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Garbled documents with their text as far as it can be restored."""
    return garbled.repair_encoding(table(spark, folder, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_restored(spark, folder).select("doc_id")


QUERIES = {f.__name__: f for f in (p2_found, p4_found, p5_found, p5_unmatched, p5_candidates, p6_found, p6_share, p8_ids, p9_found, p9_spans, p10_found, p10_restored)}

ORACLE = {
    "p4_found": """
        SELECT country, attention_id FROM task9_ukraine_yearly_attention WHERE country IS NOT NULL AND n_mentions IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY country ORDER BY n_mentions DESC, attention_id) <= 10""",
    "p9_found": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
        b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
        dw AS (SELECT doc_id, unnest(list_transform(generate_series(1, len(w) - 11), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM d WHERE len(w) >= 12),
        bw AS (SELECT item_id, unnest(list_transform(generate_series(1, len(w) - 11), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM b WHERE len(w) >= 12)
        SELECT DISTINCT doc_id, item_id FROM dw JOIN bw USING (g)""",
}
