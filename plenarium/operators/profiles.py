"""Group profiles: distributions, pivots, modes, joined marker sets, ranking, top-k at both ends, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenarium.functions import text as T


def distribution(df: DataFrame, *keys: str, least: int = 1, top: int | None = None) -> DataFrame:
    """Counts per key, the most frequent first (ties by key); ``top`` keeps so many."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return out.orderBy(F.desc("n"), *keys).limit(top) if top else out


def with_percent(counts: DataFrame, within: list[str] | None = None, value: str = "n") -> DataFrame:
    """A count table with each count's percentage of all, or of its group; empty groups give 0. The window of groups runs
    over counts, never over rows of the corpus; the total of all is a scalar."""
    total = F.sum(value).over(Window.partitionBy(*within)) if within else counts.agg(F.sum(value)).scalar()
    return counts.withColumn("percent", F.coalesce(F.try_divide(F.col(value) * 100.0, total), F.lit(0.0)))


def entity_stats(df: DataFrame, key: str, value: str, least: int = 1) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(T.exact_mean(F.col(value)), 3).alias("mean_value"), F.round(F.stddev_samp(value), 3).alias("sd_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value")).where(F.col("n") >= least)


def pivot_counts(df: DataFrame, row: str, column: str, levels: list[str]) -> DataFrame:
    """Counts of ``row`` by fixed ``levels`` of ``column`` (others are left out), 0 where absent: one pass of
    conditional counts, no second scan for the levels. Column names have their non-letters replaced by ``_``."""
    import re

    return df.groupBy(row).agg(*[F.count_if(F.col(column) == x).alias(re.sub(r"\W", "_", x)) for x in levels])


def modes(columns: list[str]) -> list[Column]:
    """The most frequent value of labels with few different ones, beside other aggregates (see ``profile`` for all in one
    pass of counts)."""
    return [F.mode(c, deterministic=True).alias(f"dominant_{c}") for c in columns]


def joined_set(column: str, name: str) -> Column:
    """Different values (empty text is one) in order, parted by commas."""
    return F.array_join(F.array_sort(F.collect_set(column)), ", ").alias(name)


def profile(df: DataFrame, keys: list[str], modal: list[str] = (), joined: list[str] = (), distinct: list[str] = (), means: dict[str, int] | None = None, spans: list[str] = ()) -> DataFrame:
    """Per key, from one pass over the rows: ``n``; the most frequent value of each ``modal`` label (``dominant_…``, the
    lowest of equals); the different values of ``joined`` ones, in order, as one text (``…_seen``); the number of
    different values of ``distinct`` ones (``n_…``); means of numbers of so many decimals (``mean_…``); first and last
    of ``spans`` (``first_…``, ``last_…``).

    Rows are grouped by key, attribute and value first, so that a key that holds most rows is one row per value and
    task before the shuffle; all results are made of these counts."""
    means = means or {}
    entry = lambda name, value: F.struct(F.lit(name).alias("attribute"), value.cast("string").alias("value"))
    labels = list(dict.fromkeys([*modal, *joined, *distinct]))
    whole = {f"__{c}": F.round(F.col(c) * 10**d).cast("long") for c, d in means.items()} | {f"__{c}": F.col(c) for c in spans}
    long = df.select(*keys, *[v.alias(k) for k, v in whole.items()], F.inline(F.array(entry("", F.lit(None)), *[entry(c, F.col(c)) for c in labels])))
    mine = lambda c: F.when(F.col("attribute") == "", F.col(c))
    first = long.groupBy(*keys, "attribute", "value").agg(
        F.count(F.lit(1)).alias("__n"),
        *[x for c in means for x in (F.sum(mine(f"__{c}")).alias(f"__s_{c}"), F.count(mine(f"__{c}")).alias(f"__c_{c}"))],
        *[x for c in spans for x in (F.min(mine(f"__{c}")).alias(f"__min_{c}"), F.max(mine(f"__{c}")).alias(f"__max_{c}"))],
    )
    value_of = lambda c: F.when((F.col("attribute") == c) & F.col("value").isNotNull(), F.col("value"))
    best = lambda c: F.min(F.when(value_of(c).isNotNull(), F.struct((-F.col("__n")).alias("minus"), F.col("value").alias("value"))))["value"]
    return first.groupBy(*keys).agg(
        F.max(mine("__n")).alias("n"),
        *[F.count(value_of(c)).alias(f"n_{c}") for c in distinct],
        *[(F.max(f"__s_{c}") / F.max(f"__c_{c}") / 10**d).alias(f"mean_{c}") for c, d in means.items()],
        *[x for c in spans for x in (F.max(f"__min_{c}").alias(f"first_{c}"), F.max(f"__max_{c}").alias(f"last_{c}"))],
        *[best(c).alias(f"dominant_{c}") for c in modal],
        *[F.array_join(F.array_sort(F.collect_list(value_of(c))), ", ").alias(f"{c}_seen") for c in joined],
    )


def mention_profile(df: DataFrame, keys: list[str], modal: list[str], joined: list[str], least: int = 1) -> DataFrame:
    """Per key: mentions, first and last year, mean score, the mode of several labels, joined sets of words."""
    out = profile(df.withColumn("year", F.col("source_year")), keys, modal, joined, means={"concreteness_score": 3}, spans=["year"]).where(F.col("n") >= least)
    return out.withColumnsRenamed({"n": "n_mentions", "mean_concreteness_score": "mean_concreteness"}).withColumn("mean_concreteness", F.round("mean_concreteness", 3))


def edges(df: DataFrame, keys: list[str], markers: list[str]) -> DataFrame:
    """Weighted directed edges: mentions and different sentences per key, with the joined marker sets."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("weight"), F.count_distinct("sentence_id").alias("n_sentences"), *[joined_set(m, f"{m}s") for m in markers])


def target_summary(edge_table: DataFrame, target: str, modal: list[str]) -> DataFrame:
    """Per target: total weight, edges, and the mode of labels over edges (each edge counts once)."""
    return edge_table.groupBy(target).agg(F.sum("weight").alias("total_weight"), F.count(F.lit(1)).alias("n_edges"), *modes(modal))


def top_share(df: DataFrame, column: str, n: int, other: str = "other") -> DataFrame:
    """``column`` with all but its ``n`` most frequent values (ties by value) as ``other``."""
    top = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(n).select(F.col(column).alias("__top"))
    return df.join(top, F.col(column) == F.col("__top"), "left").withColumn(column, F.coalesce("__top", F.lit(other))).drop("__top")


def both_ends(df: DataFrame, group: str, score: str, key: str, n: int) -> DataFrame:
    """The ``n`` highest and ``n`` lowest rows of each group by ``score`` (ties by ``key``), labelled ``example_type``. A
    row of a small group may stand at both ends.

    Rows are read once and stand for both ends; the rank filter keeps at most ``n`` of them per group, end and task
    before the shuffle. ``df`` should have no more columns than are wanted."""
    ends = F.array(F.struct(F.lit("highest").alias("example_type"), (-F.col(score)).alias("__by")), F.struct(F.lit("lowest").alias("example_type"), F.col(score).alias("__by")))
    rows = df.where(F.col(score).isNotNull() & F.col(group).isNotNull()).select("*", F.inline(ends))
    place = F.row_number().over(Window.partitionBy(group, "example_type").orderBy("__by", key)).cast("long")
    return rows.withColumn("place", place).where(F.col("place") <= n).drop("__by")


def examples_of_frequent(df: DataFrame, pair: list[str], order: list[Column], least: int, n: int) -> DataFrame:
    """``n`` example rows of every pair with at least ``least`` rows, with the pair's count.

    The count comes from an aggregate and is joined, so that no window holds a whole pair: the rank filter keeps ``n``
    rows per pair and task."""
    counts = df.groupBy(*pair).agg(F.count(F.lit(1)).alias("pair_count")).where(F.col("pair_count") >= least)
    ranked = df.withColumn("place", F.row_number().over(Window.partitionBy(*pair).orderBy(*order)).cast("long")).where(F.col("place") <= n)
    return ranked.join(counts, pair)


def hashed_order(key: str, seed: int = 42) -> Column:
    """A fixed pseudo-random order that any engine can reproduce."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows (all if fewer), the same ones on every run."""
    return df.orderBy(hashed_order(key, seed), key).limit(n)


def sample_per_stratum(df: DataFrame, strata: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows of each stratum."""
    place = F.row_number().over(Window.partitionBy(*strata).orderBy(hashed_order(key, seed), key))
    return df.withColumn("__n", place).where(F.col("__n") <= n).drop("__n")


def trend(counts: DataFrame, key: str, year: str, value: str) -> DataFrame:
    """Per key of a yearly table: first, last and peak year (the earliest of equal peaks), values there, and the change."""
    at_first, at_last = F.min_by(value, year), F.max_by(value, year)
    peak = F.min(F.struct((-F.col(value)).alias("minus"), F.col(year).alias("year")))
    return counts.groupBy(key).agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"), at_first.alias("first_value"), at_last.alias("last_value"), peak.alias("p")).select(
        key, "first_year", "last_year", "first_value", "last_value", F.col("p.year").alias("peak_year"), (-F.col("p.minus")).alias("peak_value"), (F.col("last_value") - F.col("first_value")).alias("delta")
    )


def top_values_json(df: DataFrame, key: str, columns: list[str], n: int) -> DataFrame:
    """Per key and attribute: the ``n`` most frequent values with their share, as JSON."""
    long = df.select(key, F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.col(c).cast("string") for c in columns]))).alias("attribute", "value")).where("value is not null")
    counts = long.groupBy(key, "attribute", "value").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(key, "attribute")
    ranked = counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(group), 4)).withColumn("place", F.row_number().over(group.orderBy(F.desc("n"), "value"))).where(F.col("place") <= n)
    entry = F.struct("place", "value", "n", "share")
    return ranked.groupBy(key, "attribute").agg(F.to_json(F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"), x["share"].alias("share")))).alias("distribution"))


def value_list(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: its different values with their counts, the most frequent first (ties by value), as a list of structs."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    pair = F.struct((-F.col("n")).alias("minus"), F.col(value).alias("value"))
    return counts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(pair)), lambda x: F.struct(x["value"].alias("value"), (-x["minus"]).alias("n"))).alias("value_counts"))


def nested_results(df: DataFrame, key: str, group: list[str], fields: list[str]) -> DataFrame:
    """Rows as a list of structs per key and group (different ones, in order), with its length."""
    return df.select(key, *group, *fields).distinct().groupBy(key, *group).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("records")).withColumn("n_records", F.size("records").cast("long"))


def flat_results(nested: DataFrame, key: str, group: list[str]) -> DataFrame:
    """``nested_results`` back as rows."""
    return nested.select(key, *group, F.explode("records").alias("r")).select(key, *group, "r.*")
