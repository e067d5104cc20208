"""Who speaks about whom: matrices of source and target, asymmetry, windows around shocks, salience."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenarium.functions import text as T
from plenarium.operators import mentions as M


def mode(df: DataFrame, keys: list[str], column: str, result: str) -> DataFrame:
    """The most frequent non-null value per key, the lowest of equally frequent ones.

    Grouped by key and value first: a key that holds most rows is one row per value and task before the shuffle."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("minus"), F.col(column).alias("value")))
    return counts.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.value").alias(result))


def bilateral_matrix(df: DataFrame) -> DataFrame:
    """Source × target: mentions, different speeches and speakers (nulls not counted), mean and sample deviation of
    sentiment (null for one row), the usual name of the target."""
    base = df.groupBy("country", "target_iso3").agg(
        F.count(F.lit(1)).alias("n_mentions"),
        F.count_distinct("speech_id").alias("n_speeches"),
        F.count_distinct("speaker_id").alias("n_speakers"),
        T.exact_mean(F.col("sentence_sentiment_value")).alias("mean_sentiment"),
        F.stddev_samp("sentence_sentiment_value").alias("sd_sentiment"),
        F.mode("target_name", deterministic=True).alias("target_name"),
    )
    return base


def per_sentence_counts(facts: DataFrame) -> DataFrame:
    """Persons, places and organisations named per sentence."""
    count = lambda kind: F.count_if(F.col("entity_category") == kind).alias(f"n_{kind.lower()}")
    return facts.groupBy("sentence_id").agg(count("PER"), count("LOC"), count("ORG"))


def grounded_mentions(resolved: DataFrame, facts: DataFrame) -> DataFrame:
    """Mentions with the density of grounded items (names, numbers, years) per 1,000 tokens of their three sentences."""
    window = T.three_sentences(F.col("sentence_content_previous"), F.col("sentence_content_current"), F.col("sentence_content_next"))
    rows = resolved.withColumn("window_text", window).withColumns({"n_numbers": T.numbers(F.col("window_text")), "n_years": T.years(F.col("window_text")), "n_tokens": T.spaced_tokens(F.col("window_text"))})
    joined = rows.join(per_sentence_counts(facts), "sentence_id", "left").fillna(0, ["n_per", "n_loc", "n_org"])
    items = F.col("n_per") + F.col("n_loc") + F.col("n_org") + F.col("n_numbers") + F.col("n_years")
    return joined.withColumn("grounded_score", items * 1000.0 / F.greatest(F.col("n_tokens"), F.lit(1)))


def bilateral_concreteness(df: DataFrame) -> DataFrame:
    return df.groupBy("country", "target_iso3").agg(
        F.count(F.lit(1)).alias("n_mentions"),
        F.avg("grounded_score").alias("mean_score"),
        F.median("grounded_score").alias("median_score"),
        F.stddev_samp("grounded_score").alias("sd_score"),
        F.count_distinct("speech_id").alias("n_speeches"),
    )


def asymmetry(matrix: DataFrame, least: int = 1) -> DataFrame:
    """One row per unordered pair with both directions present: counts both ways, share of the first, log ratio of the
    counts plus one, gap of sentiment, total."""
    a = matrix.select(F.col("country").alias("a"), F.col("target_iso3").alias("b"), F.col("n_mentions").alias("n_ab"), F.col("mean_sentiment").alias("sentiment_ab"))
    b = matrix.select(F.col("target_iso3").alias("a"), F.col("country").alias("b"), F.col("n_mentions").alias("n_ba"), F.col("mean_sentiment").alias("sentiment_ba"))
    both = a.where("a < b").join(b, ["a", "b"])
    total = F.col("n_ab") + F.col("n_ba")
    return both.select(
        "a", "b", "n_ab", "n_ba", (F.col("n_ab") / total).alias("share_ab"), F.ln((F.col("n_ab") + 1) / (F.col("n_ba") + 1)).alias("log_ratio"), (F.col("sentiment_ab") - F.col("sentiment_ba")).alias("sentiment_gap"), total.alias("total")
    ).where(F.col("total") >= least)


def directed_ratio(matrix: DataFrame, top: int | None = None) -> DataFrame:
    """All directed pairs with the reverse count (0 where absent), ``ratio`` = forward / (reverse + 1)."""
    forward = matrix.select(F.col("country").alias("source"), F.col("target_iso3").alias("target"), F.col("n_mentions").alias("n_forward"))
    back = forward.select(F.col("target").alias("source"), F.col("source").alias("target"), F.col("n_forward").alias("n_reverse"))
    out = forward.join(back, ["source", "target"], "left").fillna(0, ["n_reverse"]).withColumn("ratio", F.col("n_forward") / (F.col("n_reverse") + 1))
    return out.orderBy(F.desc("ratio"), F.desc("n_forward"), "source", "target").limit(top) if top else out


def smoothed_asymmetry(matrix: DataFrame, smooth: float = 0.5) -> DataFrame:
    """Directed pairs with rates per 1,000 mentions of their source, smoothed, and the log of their ratio."""
    totals = matrix.groupBy("country").agg(F.sum("n_mentions").alias("n_source"))
    pairs = directed_ratio(matrix)
    own = totals.select(F.col("country").alias("source"), "n_source")
    other = totals.select(F.col("country").alias("target"), F.col("n_source").alias("n_target"))
    rated = pairs.join(own, "source").join(other, "target", "left").fillna(0, ["n_target"])
    forward = (F.col("n_forward") + smooth) * 1000.0 / (F.col("n_source") + 1)
    reverse = (F.col("n_reverse") + smooth) * 1000.0 / (F.col("n_target") + 1)
    return rated.select("source", "target", "n_forward", "n_reverse", "n_source", "n_target", forward.alias("rate_forward"), reverse.alias("rate_reverse"), F.ln(forward / reverse).alias("log_ratio"))


def shock_window(df: DataFrame, day: str, days: int = 90) -> DataFrame:
    """Source × target: counts and mean sentiment ``days`` before and after ``day`` (both ends in; the day is after)."""
    shock = F.to_date(F.lit(day))
    near = df.where(F.col("session_date").between(F.date_sub(shock, days), F.date_add(shock, days)))
    before, s = F.col("session_date") < shock, F.col("sentence_sentiment_value")
    out = near.groupBy("country", "target_iso3").agg(
        F.count_if(before).alias("n_pre"), F.count_if(~before).alias("n_post"), T.exact_mean(F.when(before, s)).alias("sentiment_pre"), T.exact_mean(F.when(~before, s)).alias("sentiment_post")
    )
    return out.withColumns({"delta_n": F.col("n_post") - F.col("n_pre"), "delta_sentiment": F.col("sentiment_post") - F.col("sentiment_pre")})


def analysis_scope(df: DataFrame, source: str = "country", target: str = "target_iso3") -> Column:
    """self_reference, reciprocal_asymmetry_candidate (the target speaks too), or external_target. Needs the column
    ``speaks`` (see ``with_speakers``)."""
    return F.when(F.col(source) == F.col(target), "self_reference").when(F.col("speaks"), "reciprocal_asymmetry_candidate").otherwise("external_target")


def with_speakers(df: DataFrame) -> DataFrame:
    """``speaks``: whether the target is one of the sources."""
    sources = df.select(F.col("country").alias("target_iso3")).distinct().withColumn("speaks", F.lit(True))
    return df.join(sources, "target_iso3", "left").fillna(False, ["speaks"])


def normalized_asymmetry(mentions: DataFrame, units: DataFrame, least: int = 10, smooth: float = 0.5) -> DataFrame:
    """Directed pairs of at least ``least`` mentions, against four totals: all mentions of the source and of the target as
    a source, and the units (speeches, say; columns ``country``, ``units``) of both. Rates per 1,000 of each, and the
    smoothed ratio of forward to reverse mentions per unit with its log. A missing total counts as 1."""
    counts = mentions.groupBy("country", "target_iso3").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("country").agg(F.sum("n").alias("n_source"))
    sides = counts.join(totals, "country").join(units.withColumnRenamed("units", "source_units"), "country", "left")
    sides = sides.join(totals.select(F.col("country").alias("target_iso3"), F.col("n_source").alias("n_target")), "target_iso3", "left")
    sides = sides.join(units.select(F.col("country").alias("target_iso3"), F.col("units").alias("target_units")), "target_iso3", "left").fillna(1, ["source_units", "target_units"]).fillna(0, ["n_target"])
    back = counts.select(F.col("target_iso3").alias("country"), F.col("country").alias("target_iso3"), F.col("n").alias("n_reverse"))
    pairs = sides.where(F.col("n") >= least).join(back, ["country", "target_iso3"], "left").fillna(0, ["n_reverse"])
    forward, reverse = (F.col("n") + smooth) / F.col("source_units"), (F.col("n_reverse") + smooth) / F.col("target_units")
    return pairs.withColumns({
        "rate_per_1000_units": F.col("n") * 1000 / F.col("source_units"), "rate_per_1000_mentions": F.col("n") * 1000 / F.col("n_source"),
        "total": F.col("n") + F.col("n_reverse"), "raw_ratio": F.col("n") / (F.col("n_reverse") + 1), "normalized_ratio": forward / reverse, "normalized_log_ratio": F.ln(forward) - F.ln(reverse),
    })


def yearly_attention(df: DataFrame, score: str | None = None) -> DataFrame:
    """Source × target × year × scope: mentions, speeches, speakers, mean sentiment, and the mean of ``score`` if asked."""
    more = [T.exact_mean(F.col(score), 3).alias("mean_concreteness")] if score else []
    scoped = with_speakers(df)
    return (
        scoped.withColumn("analysis_scope", analysis_scope(scoped))
        .withColumn("source_year", F.year("session_date"))
        .groupBy("country", "target_iso3", "source_year", "analysis_scope")
        .agg(F.count(F.lit(1)).alias("n_mentions"), F.count_distinct("speech_id").alias("n_speeches"), F.count_distinct("speaker_id").alias("n_speakers"), T.exact_mean(F.col("sentence_sentiment_value")).alias("mean_sentiment"), *more)
    )


def yearly_total(attention: DataFrame) -> DataFrame:
    """Per year: mentions of all sources and the number of sources."""
    return attention.groupBy("source_year").agg(F.sum("n_mentions").alias("total_mentions"), F.count_distinct("country").alias("n_source_parliaments"))


def salience(attention: DataFrame, least: int = 1) -> DataFrame:
    """Source × target × scope over all years."""
    return attention.groupBy("country", "target_iso3", "analysis_scope").agg(F.sum("n_mentions").alias("n_mentions"), F.min("source_year").alias("first_year"), F.max("source_year").alias("last_year")).where(F.col("n_mentions") >= least)


def zero_filled(counts: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Every row × every column of a count table, 0 where absent. The column labels of the aggregate are one array (a
    few categories), exploded beside every row label."""
    labels = counts.agg(F.sort_array(F.collect_set(column))).scalar()
    grid = counts.select(row).distinct().select(row, F.explode(labels).alias(column))
    return grid.join(counts.select(row, column, value), [row, column], "left").fillna(0, [value])


def valid_at(date: str, start: str, end: str, open_start: bool = True) -> Column:
    """Whether an interval holds a date: both ends belong to it; an end that is null is open, a start only if asked for."""
    d, s, e = F.col(date), F.col(start), F.col(end)
    begun = s.isNull() | (s <= d) if open_start else s <= d
    return begun & (e.isNull() | (d <= e))


def best_valid(mentions: DataFrame, affiliations: DataFrame, person: list[str], date: str, start: str, end: str, values: list[str]) -> DataFrame:
    """Each row of ``mentions`` with the ``values`` of the affiliation of its person that is valid at its date (open ends
    are valid; the first of ``values`` is given): of several the one that began last, one with an open start first, then
    the lowest values. Without a valid one they are null. One row per row, repeated ones too.

    Validity depends on person and date alone, so it is found for the different days of a person, with the interval as a
    condition inside the join and partial minima after it; mentions, however many a person has on a day, only look it up."""
    held = affiliations.where(F.col(values[0]).isNotNull()).select(*person, start, end, *values)
    days = mentions.select(*person, date).dropna().distinct()
    later = -F.unix_micros(F.col(start).cast("timestamp"))  # null, the lowest, for an open start
    best = F.min(F.struct(later.alias("later"), *values)).alias("best")
    found = days.join(held, person).where(valid_at(date, start, end)).groupBy(*person, date).agg(best)
    return mentions.join(found, [*person, date], "left").withColumns({v: F.col(f"best.{v}") for v in values}).drop("best")


def all_valid(mentions: DataFrame, affiliations: DataFrame, person: list[str], date: str, start: str, end: str) -> DataFrame:
    """Every mention with every affiliation valid at its date (start given, end given or open), different rows once; the
    equality on the person makes it an ordinary join with a condition."""
    return mentions.join(affiliations, person).where(valid_at(date, start, end, open_start=False)).distinct()


def group_memberships(affiliations: DataFrame, orgs: DataFrame, role: str = "member", org_role: str = "parliamentaryGroup") -> DataFrame:
    """Affiliations in one role with the organisation (of one kind) they are with; dates as dates, null where the text
    is no whole date."""
    groups = orgs.where(F.col("org_role") == org_role).select("org_id", F.col("org_name").alias("party_group"))
    dates = {c: T.lenient_date(F.col(c)) for c in ("start_date", "end_date")}
    return affiliations.where(F.col("role") == role).withColumns(dates).join(groups, "org_id")


def member_metadata(people: DataFrame, affiliations: DataFrame, orgs: DataFrame, after: str, before: str) -> DataFrame:
    """People with their affiliations that began between two dates (compared as text, whatever their precision) and the
    organisations."""
    began = affiliations.where(M.in_window(F.col("start_date"), after, before))
    return people.join(began, ["speaker_id", "country"]).join(orgs.drop("country"), "org_id")


def topic_resolved(facts: DataFrame, names: DataFrame) -> DataFrame:
    """The dyadic track's mentions: resolved, on the topic, with the columns its aggregations use."""
    return M.topic_mentions(facts, names).select("fact_id", "sentence_id", "speech_id", "session_date", "speaker_id", "country", "target_iso3", "target_name", "sentence_sentiment_value", "sentence_content_previous", "sentence_content_current", "sentence_content_next", "entity_content", "entity_category")
