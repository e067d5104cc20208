"""Rule-based annotation of mentions: one pass of expressions, no Python in the tasks.

Every function adds columns to a table with ``context_window`` (see ``with_context``). Null and blank windows get the
labels of the written rules (``unknown``, ``ambiguous``, empty markers).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenarium.functions import text as T
from plenarium.functions import vocab
from plenarium.operators import mentions as M
from plenarium.lineage import spread

PROPER = r"\b[A-Z][A-Za-zÀ-ÿ'’-]{2,}(?:\s+[A-Z][A-Za-zÀ-ÿ'’-]{2,}){0,3}\b"
#: A letter, mark, digit or low line of any script: what may not stand beside a whole word.
WORD = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"
PLACE = "([A-Z][A-Za-zÀ-ÿ' -]{2,40})"


def with_context(df: DataFrame) -> DataFrame:
    """``context_window`` and its lower case, made once for all classifiers."""
    w = T.context_window(F.col("sentence_content_previous"), F.col("sentence_content_current"), F.col("sentence_content_next"))
    return df.withColumn("context_window", w).withColumn("context_lower", F.lower("context_window"))


def reference_type(low: Column, p: Column, s: Column) -> Column:
    """policy, situation, mixed, neutral_reference, or unknown for a null or blank text, from the different markers of
    both vocabularies found (``p``, ``s``)."""
    return (
        F.when(low.isNull() | (F.trim(low) == ""), "unknown")
        .when((p == 0) & (s == 0), "neutral_reference")
        .when((p >= 2) & (s >= 2), "mixed")
        .when(p > s, "policy")
        .when(s > p, "situation")
        .otherwise("mixed")
    )


def sentiment_level(label: Column) -> Column:
    return F.when(label.isin(list(vocab.SENTIMENTS)), label).otherwise("unknown")


def add_typology(df: DataFrame) -> DataFrame:
    """Reference type and sentiment labels. The marker counts are columns first, so that each is made once."""
    low = F.col("context_lower")
    counted = df.withColumns({"__p": T.hits(low, vocab.POLICY), "__s": T.hits(low, vocab.SITUATION), "sentiment_level": sentiment_level(F.col("sentence_sentiment_ana"))})
    level = F.col("sentiment_level")
    return counted.withColumns({
        "ref_type": reference_type(low, F.col("__p"), F.col("__s")),
        "sentiment_readable": T.lookup(level, {k: v[0] for k, v in vocab.SENTIMENTS.items()}, "unknown"),
        "sentiment_polarity": T.lookup(level, {k: v[1] for k, v in vocab.SENTIMENTS.items()}, "unknown"),
    }).drop("__p", "__s")


def add_geo(df: DataFrame, names: DataFrame) -> DataFrame:
    """Canonical name, ISO3 code, geography groups and scope. ``names`` is the table of accepted names."""
    codes = names.groupBy(F.col("country_name").alias("entity_name")).agg(F.min("iso3").alias("target_iso3"))
    named = df.withColumn("entity_name", M.canonical_name(F.col("entity_content"))).join(codes, "entity_name", "left")
    c, iso = F.col("entity_name"), F.col("target_iso3")
    return named.withColumns({"geo_class": M.geo_class(c), "region_group": M.region_group(c, iso), "weog_group": M.weog_group(c, iso), "entity_scope": M.entity_scope(c, iso)})


def token_tenths(t: Column, entity: Column) -> Column:
    """Concreteness of one token in tenths, so that sums are exact."""
    suffix = t.endswith("tion") | t.endswith("ity") | t.endswith("ism") | t.endswith("ness") | t.endswith("ment")
    return (
        F.when(F.array_contains(entity, t), 50)
        .when(t.isin(vocab.CONCRETE), 45)
        .when(t.isin(vocab.ABSTRACT), 20)
        .when(suffix, 26)
        .otherwise(32)
    )


def concreteness_band(score: Column) -> Column:
    return F.when(score.isNull(), "unknown").when(score < 3.2, "abstract").when(score >= 3.3, "concrete").otherwise("mixed")


def add_concreteness(df: DataFrame) -> DataFrame:
    """Score (mean of token scores, null without tokens), band, token count, and the marker words seen.

    Tokens are cut once. A token of the mentioned entity counts 5.0, a concrete word 4.5, an abstract one 2.0, an
    abstract suffix 2.6, any other 3.2."""
    toks = df.withColumn("__t", T.tokens(F.col("context_window"))).withColumn("__e", T.tokens(F.col("entity_content")))
    n, t, e = F.size("__t"), F.col("__t"), F.col("__e")
    total = F.aggregate(F.transform(t, lambda x: token_tenths(x, e)), F.lit(0), lambda a, x: a + x)
    score = F.when(n > 0, F.round(total / n / 10, 3))

    def seen(words: list[str]) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.filter(t, lambda x: x.isin(words)))), ", ")

    return (
        toks.withColumn("concreteness_score", score)
        .withColumn("concreteness_band", concreteness_band(F.col("concreteness_score")))
        .withColumn("n_tokens", n.cast("long"))
        .withColumn("concrete_words", seen(vocab.CONCRETE))
        .withColumn("abstract_words", seen(vocab.ABSTRACT))
        .withColumn("concreteness_method", F.lit("fallback_rules"))
        .drop("__t", "__e")
    )


def add_lexicon_concreteness(df: DataFrame, lexicon: DataFrame, key: str) -> DataFrame:
    """``key`` and ``concreteness_score`` by a word list (``word``, ``score``) that may be long: tokens are exploded,
    joined to the list and averaged per row. Words outside the list do not count; rows without one get null."""
    toks = df.select(key, F.explode(T.tokens(F.col("context_window"))).alias("word"))
    scored = toks.join(lexicon, "word").groupBy(key).agg(F.round(F.avg("score"), 3).alias("concreteness_score"))
    return df.select(key).join(scored, key, "left")


def add_cohort_and_measure(df: DataFrame) -> DataFrame:
    low = F.col("context_lower")
    marked = df.withColumns({"cohort_marker": T.class_first(low, vocab.COHORTS), "measure_marker": T.class_first(low, vocab.MEASURES)})
    return marked.withColumns({
        "migrant_cohort": T.class_of(F.col("cohort_marker"), vocab.COHORTS, "unspecified"),
        "policy_measure": T.class_of(F.col("measure_marker"), vocab.MEASURES, "unspecified"),
        "diffusion_method": F.lit("keyword_rules"),
    })


def add_agency(df: DataFrame) -> DataFrame:
    marked = df.withColumn("agency_marker", T.class_first(F.col("context_lower"), vocab.AGENCY))
    return marked.withColumn("policy_agency", T.class_of(F.col("agency_marker"), vocab.AGENCY, "neutral_reporting"))


def argument_scheme(low: Column) -> Column:
    defined = F.coalesce(low.rlike(rf"\b({vocab.DEFINED})\s+({vocab.DEFINES})\b"), F.lit(False))
    return F.when(defined, "conceptual_definition").when(T.contains_any(low, vocab.CONSEQUENCE), "argument_from_consequences").when(T.contains_any(low, vocab.PRACTICAL), "practical_reasoning").otherwise("other")


def definition_snippet(window: Column) -> Column:
    """80 characters before to 220 after the first definition; empty if there is none."""
    pattern = rf"(?i)\b({vocab.DEFINED})\s+({vocab.DEFINES})\b"
    at, found = F.regexp_instr(window, F.lit(pattern)), F.regexp_substr(window, F.lit(pattern))
    start = F.greatest(F.lit(1), at - 80)
    cut = F.substring(window, start, at + F.length(found) + 220 - start)
    return F.coalesce(F.when(at > 0, T.compact(cut)), F.lit(""))


def frame_polarity(frame: Column) -> Column:
    return T.lookup(frame, {f: p for p, fs in vocab.FRAME_POLARITY.items() for f in fs}, "neutral_administrative")


def add_framing(df: DataFrame, frames: dict[str, list[str]] = vocab.FRAMES) -> DataFrame:
    low = F.col("context_lower")
    return (
        df.withColumn("frame_marker", T.class_first(low, frames))
        .withColumn("narrative_frame", T.class_of(F.col("frame_marker"), frames, "neutral_reporting"))
        .withColumn("frame_polarity", frame_polarity(F.col("narrative_frame")))
        .withColumn("argument_scheme", argument_scheme(low))
        .withColumn("definition_snippet", definition_snippet(F.col("context_window")))
        .withColumn("framing_method", F.lit("keyword_rules"))
    )


def direction(low: Column, home: str = "france", land: str = "french territory") -> Column:
    """How a movement runs relative to the speaker's country. ``home`` is that country's name, in lower case."""
    near = T.contains_any(low, ["come to", "arrive in", "arrival in", f"into {home}", f"to {home}", f"in {home}", home, "our country", land])
    inward = T.contains_any(low, ["arrive", "arrival", "come", "enter", "into", "asylum in"])
    outward = T.contains_any(low, [f"from {home}", f"leave {home}", f"leaving {home}"])
    across = T.contains_any(low, ["from", "to", "into", "towards", "between"])
    return F.when(near & inward, "inbound_internal").when(outward, "outbound_from_domestic").when(across, "external_transnational").otherwise("ambiguous")


def flow_end(window: Column, words: list[str]) -> Column:
    """The capitalised name after the first of ``words`` (tried in order) that has one; empty if none. Letters and spaces
    of all scripts bound the word."""
    found = [F.nullif(F.regexp_extract(window, rf"(?U)\b{w}\s+{PLACE}", 1), F.lit("")) for w in words]
    return F.coalesce(*[F.btrim(x, F.lit(" .,;:")) for x in found], F.lit(""))


def add_direction(df: DataFrame, home: str = "france") -> DataFrame:
    w = F.col("context_window")
    return df.withColumns({
        "flow_source": flow_end(w, ["from", "leaving"]),
        "flow_destination": flow_end(w, ["to", "into", "towards", "in"]),
        "migration_direction": direction(F.col("context_lower"), home),
        "direction_method": F.lit("surface_rules"),
    })


def anchors(window: Column, most: int = 8) -> Column:
    """Names of one to four capitalised words, the first ``most`` different ones."""
    found = F.regexp_extract_all(F.replace(F.coalesce(window, F.lit("")), F.lit("||"), F.lit(" ")), F.lit(PROPER), F.lit(0))
    return F.array_join(F.slice(F.array_distinct(F.transform(found, F.trim)), 1, most), ", ")


def named_countries(window: Column, names: list[str]) -> Column:
    """Accepted names found in a text as whole words of any script, longest first; a list with repeats."""
    import re

    pattern = rf"(?<!{WORD})(?:" + "|".join(re.escape(n) for n in sorted(names, key=lambda n: (-len(n), n))) + rf")(?!{WORD})"
    return F.regexp_extract_all(F.coalesce(window, F.lit("")), F.lit(pattern), F.lit(0))


def prompt_text(entity: Column, source: Column, window: Column) -> Column:
    return F.concat(F.lit("Source: "), source, F.lit("\nTarget: "), entity, F.lit("\nText: "), T.excerpt(window, 900))


def annotate(df: DataFrame, names: DataFrame, home: str = "france") -> DataFrame:
    """All annotations of a mention in one narrow pass (one small join for the codes)."""
    return (
        with_context(df)
        .transform(add_typology)
        .transform(add_geo, names)
        .transform(add_concreteness)
        .transform(add_cohort_and_measure)
        .transform(add_agency)
        .transform(add_framing)
        .transform(add_direction, home)
        .withColumn("source_year", F.year("session_date"))
    )


def annotated_mentions(facts: DataFrame, names: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """The annotated table of mentions on the topic: filter, select places, drop own names, annotate, drop own codes."""
    chosen = M.drop_domestic(M.filter_places(M.filter_topic(facts, True, True)))
    if excluded:
        chosen = M.filter_foreign(chosen, excluded)
    return M.drop_self(annotate(spread(chosen, facts), names)).where(F.col("entity_scope") != "invalid")


def concrete_events(df: DataFrame, least: float = 3.3) -> DataFrame:
    """Mentions with a high score, with names and year found in their text, the most concrete first."""
    return df.where(F.col("concreteness_score") >= least).withColumns({"event_anchors": anchors(F.col("context_window")), "n_years": T.years(F.col("context_window")), "excerpt": T.excerpt(F.col("context_window"))})


def locate(df: DataFrame, key: str, text: str, places: list[tuple] = vocab.PLACES) -> DataFrame:
    """``key`` and each place (with coordinates) one of whose aliases stands in ``text`` as a whole word. Places are an
    array of literals, so rows are tested in place, without a join."""
    import re

    tests = []
    for name, names, lat, lon, kind in places:
        pattern = rf"(?<!{WORD})(?:" + "|".join(re.escape(a) for a in sorted(names, key=lambda a: (-len(a), a))) + rf")(?!{WORD})"
        tests.append(F.when(F.col(text).rlike(pattern), F.struct(F.lit(name).alias("place"), F.lit(lat).alias("latitude"), F.lit(lon).alias("longitude"), F.lit(kind).alias("kind"))))
    return df.select(key, F.explode(F.filter(F.array(*tests), lambda p: p.isNotNull())).alias("p")).select(key, "p.*")
