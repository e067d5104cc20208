"""Matrices in long form: shares, z-scores, cosine similarity, lift, residuals, correspondence analysis, PageRank.

A matrix is a table (row, column, value). Matrices are aggregates: their size depends on the number of different labels,
not on the corpus; they stay distributed all the same, save for the singular value decomposition of a small table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenarium.functions import text as T
from plenarium.lineage import cut

#: Cells of a table that is decomposed in the driver; larger ones are refused.
MAX_CELLS = 250_000


def shares(counts: DataFrame, row: str, column: str, value: str, columns: DataFrame | None = None) -> DataFrame:
    """Each cell's share of its row's total over all columns; ``columns`` keeps some of them afterwards."""
    total = F.sum(value).over(Window.partitionBy(row))
    out = counts.withColumn("share", F.try_divide(F.col(value).cast("double"), total))
    return out.join(columns, column, "left_semi") if columns is not None else out


def top_columns(counts: DataFrame, column: str, value: str, n: int) -> DataFrame:
    """The ``n`` columns with the greatest totals (ties by label)."""
    return counts.groupBy(column).agg(F.sum(value).alias("__n")).orderBy(F.desc("__n"), column).limit(n).select(column)


def masked_means(df: DataFrame, row: str, column: str, value: str, least: int = 20) -> DataFrame:
    """Cell means, null where a cell has fewer than ``least`` rows."""
    return df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= least, T.exact_mean(F.col(value))).alias("mean_value"))


def profile_features(df: DataFrame, row: str, target: str, value: str) -> DataFrame:
    """Size features of every source as (row, feature, value): logs of mentions, speeches and speakers, different
    targets, mean sentiment."""
    wide = df.groupBy(row).agg(
        F.log1p(F.count(F.lit(1))).alias("log_mentions"),
        F.log1p(F.count_distinct("speech_id")).alias("log_speeches"),
        F.log1p(F.count_distinct("speaker_id")).alias("log_speakers"),
        F.count_distinct(target).cast("double").alias("n_targets"),
        T.exact_mean(F.col(value)).alias("mean_sentiment"),
    )
    names = ["log_mentions", "log_speeches", "log_speakers", "n_targets", "mean_sentiment"]
    return wide.unpivot([row], names, "feature", "value")


def attribute_shares(df: DataFrame, row: str, attribute: str) -> DataFrame:
    """Share of each label of an attribute among a source's rows, as features ``attribute=label``."""
    counts = df.where(F.col(attribute).isNotNull()).groupBy(row, attribute).agg(F.count(F.lit(1)).alias("n"))
    return shares(counts, row, attribute, "n").select(row, F.concat(F.lit(f"{attribute}="), F.col(attribute).cast("string")).alias("feature"), F.col("share").alias("value"))


def comparative_features(df: DataFrame, row: str, levels: list[str], target: str, top: int, means: dict[str, int], ids: dict[str, str]) -> DataFrame:
    """Every feature of every source as (row, feature, value), 0 where absent: logs of mentions and of different ``ids``
    (feature name by column), different targets, means of numbers of so many decimals, the share of each label of
    ``levels`` (``level=label``), and of the ``top`` most named targets.

    The mentions are read once: rows are counted by source, attribute and value; the counts by source and label, a
    small table, are written to the shared checkpoint folder, and all features are made of them."""
    entry = lambda name, value: F.struct(F.lit(name).alias("attribute"), value.cast("string").alias("value"))
    whole = {f"__{c}": F.round(F.col(c) * 10**d).cast("long") for c, d in means.items()}
    long = df.select(row, *[v.alias(k) for k, v in whole.items()], F.inline(F.array(entry("", F.lit("")), *[entry(c, F.col(c)) for c in (*levels, target, *ids.values())])))
    sums = lambda first: [x for c in means for x in ((F.sum(F.when(F.col("attribute") == "", F.col(f"__{c}"))), F.count(F.when(F.col("attribute") == "", F.col(f"__{c}")))) if first else (F.sum(f"__s_{c}"), F.sum(f"__c_{c}")))]
    names = [x for c in means for x in (f"__s_{c}", f"__c_{c}")]
    counts = long.where("value is not null").groupBy(row, "attribute", "value").agg(F.count(F.lit(1)).alias("n"), *[x.alias(a) for x, a in zip(sums(True), names, strict=True)])
    label = F.when(F.col("attribute").isin([*levels, target]), F.col("value"))
    counts = cut(counts.groupBy(row, "attribute", label.alias("label")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_values"), *[x.alias(a) for x, a in zip(sums(False), names, strict=True)]))

    def of(attribute: str, figure: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("attribute") == attribute, F.col(figure))), F.lit(0))

    sizes = {"log_mentions": F.log1p(of("", "n").cast("double"))} | {name: F.log1p(of(c, "n_values").cast("double")) for name, c in ids.items()} | {"n_targets": of(target, "n_values").cast("double")}
    sizes |= {f"mean_{c}": F.coalesce(F.try_divide(F.sum(f"__s_{c}"), F.sum(f"__c_{c}")) / 10**d, F.lit(0.0)) for c, d in means.items()}
    wide = counts.groupBy(row).agg(of("", "n").alias("__total"), *[v.alias(k) for k, v in sizes.items()])
    totals = wide.select(row, "__total")
    targets = counts.where(F.col("attribute") == target)
    top_targets = targets.groupBy("label").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "label").limit(top).select("label")
    shown = counts.where(F.col("attribute").isin(levels)).unionByName(targets.join(top_targets, "label", "left_semi"))
    shares_of = shown.join(totals, row).select(row, F.concat("attribute", F.lit("="), "label").alias("feature"), (F.col("n") / F.col("__total")).alias("value"))
    return complete(wide.drop("__total").unpivot([row], list(sizes), "feature", "value").unionByName(shares_of), row)


def complete(features: DataFrame, row: str) -> DataFrame:
    """Every feature for every source, 0 where absent: the feature names as one array beside each source."""
    names = features.agg(F.sort_array(F.collect_set("feature"))).scalar()
    grid = features.select(row).distinct().select(row, F.explode(names).alias("feature"))
    return grid.join(features, [row, "feature"], "left").fillna(0.0, ["value"])


def zscores(features: DataFrame, row: str, clip: float = 2.5) -> DataFrame:
    """Population z-scores per feature, 0 where a feature does not vary, clipped."""
    w = Window.partitionBy("feature")
    z = F.coalesce(F.try_divide(F.col("value") - F.avg("value").over(w), F.nullif(F.stddev_pop("value").over(w), F.lit(0.0))), F.lit(0.0))
    return features.withColumn("z", F.greatest(F.lit(-clip), F.least(F.lit(clip), z)))


def cosine(features: DataFrame, row: str, value: str) -> DataFrame:
    """Cosine of every two sources a < b over a complete table; a zero row counts as length 1; clipped to ±1.

    Sources are speaking parliaments (a label set), so that all pairs of them are the result asked for; the join is on
    the feature, with partial sums."""
    norm = F.sqrt(F.sum(F.col(value) * F.col(value)).over(Window.partitionBy(row)))
    unit = features.select(F.col(row).alias("a"), "feature", (F.col(value) / F.when(norm == 0, 1.0).otherwise(norm)).alias("u"))
    other = unit.select(F.col("a").alias("b"), "feature", F.col("u").alias("v"))
    return unit.join(other, "feature").where("a < b").groupBy("a", "b").agg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sum(F.col("u") * F.col("v")))).alias("similarity"))


def policy_pairs(cells: DataFrame, cross: DataFrame, quiet: int, loud: int, similar: float = 0.5, least_cross: int = 30, shown: int = 3) -> DataFrame:
    """Pairs of sources with similar profiles, in two strata: the ``quiet`` most similar of all, and of those with a
    similarity from ``similar`` and at least ``least_cross`` mentions of each other, the ``loud`` most mentioned.

    ``cells``: ``country``, ``feature``, ``value`` (a profile); ``cross``: ``country``, ``target_iso3``, ``n``. Columns
    ``a`` < ``b``, ``similarity``, mentions both ways, their sum, and the ``shown`` cells that add most to the similarity.
    Sources are speaking parliaments, so that their pairs are few."""
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("country")))
    unit = cells.select(F.col("country").alias("a"), "feature", (F.col("value") / norm).alias("u"))
    shared = unit.join(unit.select(F.col("a").alias("b"), "feature", F.col("u").alias("v")), "feature").where("a < b").select("a", "b", "feature", F.round(F.col("u") * F.col("v"), 9).alias("part"))
    entry = F.struct((-F.col("part")).alias("minus"), "feature")
    pairs = shared.groupBy("a", "b").agg(F.round(F.sum("part"), 6).alias("similarity"), F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(entry)), 1, shown), lambda x: x["feature"]), "; ").alias("shared_cells"))
    there = cross.select(F.col("country").alias("a"), F.col("target_iso3").alias("b"), F.col("n").alias("n_ab"))
    back = cross.select(F.col("target_iso3").alias("a"), F.col("country").alias("b"), F.col("n").alias("n_ba"))
    pairs = cut(pairs.join(there, ["a", "b"], "left").join(back, ["a", "b"], "left").fillna(0, ["n_ab", "n_ba"]).withColumn("cross_total", F.col("n_ab") + F.col("n_ba")))
    most_similar = pairs.orderBy(F.desc("similarity"), "a", "b").limit(quiet)
    most_mentioned = pairs.where((F.col("similarity") >= similar) & (F.col("cross_total") >= least_cross)).orderBy(F.desc("cross_total"), "a", "b").limit(loud)
    return most_similar.union(most_mentioned).distinct()


def coordinate_table(counts: DataFrame, row: str, column: str) -> DataFrame:
    """Rows and columns of a correspondence analysis with coordinates, mass, mentions and their greatest residuals."""
    cells = residuals(counts, row, column).withColumn("residual", F.round("residual", 9))
    own = lambda kind, c, other: counts.groupBy(F.col(c).alias("label")).agg(F.sum("n").alias("mentions")).join(top_residuals(cells, c, other).withColumnRenamed(c, "label"), "label", "left").withColumn("kind", F.lit(kind))
    both = own("row", row, column).unionByName(own("column", column, row))
    return correspondence(counts, row, column).select("kind", "label", "dim1", "dim2", "mass").join(both, ["kind", "label"])


def extremes(pairs: DataFrame, value: str, n: int = 8) -> DataFrame:
    """The ``n`` highest and lowest rows of a pair table."""
    high = pairs.orderBy(F.desc(value), "a", "b").limit(n).withColumn("kind", F.lit("closest"))
    return high.unionByName(pairs.orderBy(F.asc(value), "a", "b").limit(n).withColumn("kind", F.lit("divergent")))


def signatures(z: DataFrame, row: str, n: int = 4) -> DataFrame:
    """The ``n`` highest positive z features of every source as one text (size features left out)."""
    sizes = ["log_mentions", "log_speeches", "log_speakers", "n_targets"]
    place = F.row_number().over(Window.partitionBy(row).orderBy(F.desc("z"), "feature"))
    top = z.where((F.col("z") > 0) & ~F.col("feature").isin(sizes)).withColumn("place", place).where(F.col("place") <= n)
    return top.groupBy(row).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "feature"))), lambda x: x["feature"]), ", ").alias("signature"))


def lift(df: DataFrame, row: str, column: str, least: int = 20) -> DataFrame:
    """Share of a label within a source over its share in the corpus, for cells of at least ``least`` rows."""
    counts = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    inside = F.col("n") / F.sum("n").over(Window.partitionBy(row))
    overall = F.sum("n").over(Window.partitionBy(column)) / counts.agg(F.sum("n")).scalar()
    return counts.withColumns({"share": inside, "corpus_share": overall}).where(F.col("n") >= least).withColumn("lift", F.col("share") / F.col("corpus_share"))


def contingency(df: DataFrame, row: str, column: str, least_row: int, least_column: int, top: int) -> DataFrame:
    """Counts of rows with at least ``least_row`` mentions, then columns with at least ``least_column`` among them, of
    these the ``top`` most frequent; empty rows fall away."""
    counts = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.groupBy(row).agg(F.sum("n").alias("t")).where(F.col("t") >= least_row).select(row)
    kept = counts.join(rows, row, "left_semi")
    columns = kept.groupBy(column).agg(F.sum("n").alias("t")).where(F.col("t") >= least_column).orderBy(F.desc("t"), column).limit(top).select(column)
    return kept.join(columns, column, "left_semi")


def residuals(counts: DataFrame, row: str, column: str) -> DataFrame:
    """(n − e) / √e of every cell that is there, e expected from the margins."""
    expected = F.sum("n").over(Window.partitionBy(row)) * F.sum("n").over(Window.partitionBy(column)) / counts.agg(F.sum("n")).scalar()
    return counts.withColumn("expected", expected).withColumn("residual", (F.col("n") - F.col("expected")) / F.sqrt("expected"))


def top_residuals(cells: DataFrame, row: str, column: str, n: int = 3) -> DataFrame:
    """The ``n`` greatest positive residuals of every row, as text."""
    place = F.row_number().over(Window.partitionBy(row).orderBy(F.desc("residual"), column))
    top = cells.where("residual > 0").withColumn("place", place).where(F.col("place") <= n)
    return top.groupBy(row).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col(column).alias("label")))), lambda x: x["label"]), ", ").alias("top_residuals"))


def correspondence(counts: DataFrame, row: str, column: str) -> DataFrame:
    """Correspondence analysis: ``kind`` (row or column), ``label``, principal coordinates ``dim1`` and ``dim2``, ``mass``,
    and the inertia shares of both dimensions. The counts come from a distributed grouping; the table itself (at most
    ``MAX_CELLS`` cells, checked) is decomposed in the driver. Signs: each dimension's greatest coordinate of a row is
    positive."""
    cells = counts.select(row, column, "n").limit(MAX_CELLS + 1).collect()
    rows, columns = sorted({c[0] for c in cells}), sorted({c[1] for c in cells})
    if len(rows) * len(columns) > MAX_CELLS:
        raise ValueError(f"the table has more than {MAX_CELLS} cells")
    schema = "kind string, label string, dim1 double, dim2 double, mass double, inertia1 double, inertia2 double"
    if min(len(rows), len(columns)) < 2:
        return counts.sparkSession.createDataFrame([], schema)
    p = np.zeros((len(rows), len(columns)))
    at_row, at_col = {x: i for i, x in enumerate(rows)}, {x: i for i, x in enumerate(columns)}
    for a, b, n in cells:
        p[at_row[a], at_col[b]] += n
    p /= p.sum()
    r, c = p.sum(1), p.sum(0)
    u, d, vt = np.linalg.svd((p - np.outer(r, c)) / np.sqrt(np.outer(r, c)), full_matrices=False)
    f, g = u * d / np.sqrt(r)[:, None], vt.T * d / np.sqrt(c)[:, None]
    sign = np.sign(f[np.abs(f).argmax(0), np.arange(f.shape[1])])
    f, g, inertia = f * sign, g * sign, d**2 / (d**2).sum()
    f, g, inertia = (np.pad(x, [(0, 0)] * (x.ndim - 1) + [(0, 1)]) for x in (f, g, inertia))
    out = [("row", str(x), *map(float, (f[i, 0], f[i, 1], r[i], inertia[0], inertia[1]))) for i, x in enumerate(rows)]
    out += [("column", str(x), *map(float, (g[i, 0], g[i, 1], c[i], inertia[0], inertia[1]))) for i, x in enumerate(columns)]
    return counts.sparkSession.createDataFrame(out, schema)


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-10) -> DataFrame:
    """``node`` and ``rank`` of a weighted directed graph (``source``, ``target``, ``weight``; parallel edges are added
    up). Rank of nodes without outgoing edges is spread evenly. Each round is one join and one grouping; every tenth is
    written to the shared checkpoint folder, which also gives the change that ends the loop."""
    e = edges.groupBy("source", "target").agg(F.sum("weight").cast("double").alias("weight")).where("weight > 0")
    e = cut(e.withColumn("part", F.col("weight") / F.sum("weight").over(Window.partitionBy("source"))).select("source", "target", "part"))
    nodes = cut(e.select(F.col("source").alias("node")).union(e.select("target")).distinct().join(e.select(F.col("source").alias("node")).distinct().withColumn("out", F.lit(1)), "node", "left"))
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    ranks = nodes.select("node", "out", F.lit(1.0 / n).alias("rank"), F.lit(1.0 / n).alias("last"))
    for i in range(1, rounds + 1):
        sent = e.join(ranks.select(F.col("node").alias("source"), "rank"), "source").groupBy(F.col("target").alias("node")).agg(F.sum(F.col("rank") * F.col("part")).alias("got"))
        idle = F.coalesce(ranks.agg(F.sum(F.when(F.col("out").isNull(), F.col("rank")))).scalar(), F.lit(0.0))
        new = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + idle / n)
        ranks = ranks.select("node", "out", F.col("rank").alias("last")).join(sent, "node", "left").select("node", "out", new.alias("rank"), "last")
        if i % 5 == 0 or i == rounds:
            ranks = cut(ranks)
            if ranks.agg(F.sum(F.abs(F.col("rank") - F.col("last")))).first()[0] < tolerance * n:
                break
    return ranks.select("node", "rank")


def binned_density(df: DataFrame, group: str, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Share of a group's rows per bin of ``value`` (values outside fall into the end bins)."""
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / (high - low) * bins).cast("int")))
    counts = df.where(F.col(value).isNotNull()).groupBy(group, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))
