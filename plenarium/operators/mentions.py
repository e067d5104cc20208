"""Selecting mentions: topic and vocabulary filters, entity filters, resolver, geography."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenarium.functions import text as T
from plenarium.functions import vocab


def filter_topic(df: DataFrame, use_topic: bool = True, use_keywords: bool = False, topic: str = vocab.TOPIC, keywords: Iterable[str] = vocab.KEYWORDS) -> DataFrame:
    """Rows of the topic or with a keyword in the three sentences; all rows if neither is asked for. The cheap topic
    test comes first and reaches the scan."""
    tests = []
    if use_topic:
        tests.append(F.coalesce(F.col("debate_topic") == topic, F.lit(False)))
    if use_keywords:
        window = T.three_sentences(F.col("sentence_content_previous"), F.col("sentence_content_current"), F.col("sentence_content_next"))
        tests.append(F.lower(window).rlike(T.keyword_pattern(keywords)))
    return df.where(tests[0] | tests[1] if len(tests) == 2 else tests[0]) if tests else df


def filter_places(df: DataFrame, union: Iterable[str] = vocab.UNION) -> DataFrame:
    """Places, and the union's organisations."""
    c = F.col("entity_category")
    return df.where((c == "LOC") | (c == "ORG") & F.col("entity_content").isin(list(union)))


def filter_foreign(df: DataFrame, excluded: Iterable[str]) -> DataFrame:
    """Rows whose entity is not in ``excluded`` (nulls go)."""
    return df.where(~F.col("entity_content").isin(list(excluded)))


def filter_allowed(df: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows whose entity is in the column ``entity_content`` of ``allowed``; the size of that table decides the join."""
    return df.join(allowed.select("entity_content").distinct(), "entity_content", "left_semi")


def drop_domestic(df: DataFrame, names: dict[str, list[str]] = vocab.DOMESTIC) -> DataFrame:
    """Rows where a parliament does not speak of its own country by one of its names."""
    own = F.lit(False)
    for country, aliases in names.items():
        own = own | (F.col("country") == country) & F.col("entity_content").isin(aliases)
    return df.where(~F.coalesce(own, F.lit(False)))


def drop_self(df: DataFrame) -> DataFrame:
    return df.where(F.col("target_iso3").isNull() | (F.col("target_iso3") != F.col("country")))


def canonical_name(c: Column, aliases: dict[str, str] = vocab.ALIASES) -> Column:
    """An alias' name, or the text itself."""
    pairs = [F.lit(x) for kv in aliases.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), c)


def geo_class(c: Column) -> Column:
    return F.when(c.isin(vocab.UNION), "european_union").when(c.isin(vocab.TERRITORIES), "territory_region").when(c.isin(vocab.REGIONS), "analytical_region").otherwise("foreign")


def region_group(c: Column, iso3: Column) -> Column:
    kind = geo_class(c)
    return F.when(kind != "foreign", kind).when(iso3.isin(vocab.EUROPE), "european_country").otherwise("non_european_country")


def weog_group(c: Column, iso3: Column) -> Column:
    kind = geo_class(c)
    return F.when(kind != "foreign", kind).when(iso3.isin(vocab.WEOG), "weog").when(iso3.isNotNull(), "non_weog").otherwise("unknown")


def entity_scope(c: Column, iso3: Column) -> Column:
    kind = geo_class(c)
    return F.when(kind != "foreign", kind).when(iso3.isNotNull(), "country").otherwise("invalid")


def display_label(c: Column, kind: Column) -> Column:
    suffix = F.when(kind == "european_union", " (EU)").when(kind == "territory_region", " (overseas)").otherwise("")
    return F.concat(c, suffix)


def resolver(names: DataFrame, aliases: dict[str, str] = vocab.RESOLVER_ALIASES, compat: bool = False) -> DataFrame:
    """``alias_normal``, ``target_name``, ``target_iso3``, ``confidence``, ``origin`` from a table of accepted names
    (``iso3``, ``country_name``, ``name_kind``): short names 1.0, other names 0.96, aliases of them 0.94. Of equal
    normal forms of one country the surest is kept; aliases without a country are left out."""
    kinds = F.when(F.col("name_kind") == "short", 1.0).otherwise(0.96)
    own = names.select(F.col("country_name").alias("alias"), "country_name", "iso3", kinds.alias("confidence"), F.col("name_kind").alias("origin"))
    session = names.sparkSession
    more = session.createDataFrame(list(aliases.items()), "alias string, country_name string") if aliases else session.createDataFrame([], "alias string, country_name string")
    given = more.join(names.select("country_name", "iso3").distinct(), "country_name").select("alias", "country_name", "iso3", F.lit(0.94).alias("confidence"), F.lit("alias").alias("origin"))
    short = names.where("name_kind = 'short'").groupBy("iso3").agg(F.min("country_name").alias("short_name"))
    rows = own.unionByName(given).join(short, "iso3", "left").withColumn("alias_normal", T.normal(F.col("alias"), compat))
    first = Window.partitionBy("alias_normal", "iso3").orderBy(F.desc("confidence"), "alias")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").select("alias_normal", F.coalesce("short_name", "country_name").alias("target_name"), F.col("iso3").alias("target_iso3"), "confidence", "origin")


def resolve(df: DataFrame, names: DataFrame, least: float = 0.85, compat: bool = False) -> DataFrame:
    """Mentions (no persons) with the country they name; a mention of several countries has a row each; mentions of the
    speaker's own country and unsure ones are left out. The resolver holds the list of names only; Catalyst broadcasts
    it where its measured size allows."""
    table = resolver(names, compat=compat)
    keyed = df.where(F.col("entity_category").isin("LOC", "ORG", "MISC")).withColumn("alias_normal", T.normal(F.col("entity_content"), compat))
    return keyed.join(table, "alias_normal").where((F.col("target_iso3") != F.col("country")) & (F.col("confidence") >= least))


def topic_speeches(df: DataFrame, min_hits: int = 2, topic: str = vocab.TOPIC, stems: Iterable[str] = vocab.STEMS) -> DataFrame:
    """Speeches with at least ``min_hits`` mention rows on the topic or with a stem in their three sentences."""
    window = F.lower(T.three_sentences(F.col("sentence_content_previous"), F.col("sentence_content_current"), F.col("sentence_content_next")))
    hit = F.coalesce(F.col("debate_topic") == topic, F.lit(False)) | window.rlike(T.stem_pattern(stems))
    return df.where(hit).groupBy("speech_id").agg(F.count(F.lit(1)).alias("n_hits")).where(F.col("n_hits") >= min_hits)


def topic_mentions(df: DataFrame, names: DataFrame, min_hits: int = 2) -> DataFrame:
    """Resolved mentions of speeches on the topic (a semi-join; speech rows never multiply)."""
    return resolve(df, names).join(topic_speeches(df, min_hits), "speech_id", "left_semi")


def in_window(c: Column, low: str, high: str) -> Column:
    """Dates as text between two bounds, compared as text."""
    return (c > low) & (c < high)


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order`` (which must be total for a defined result)."""
    n = "__n"
    return df.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(n) == 1).drop(n)
