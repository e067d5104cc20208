"""Pieces of DuckDB SQL that the oracles share, written from the same vocabularies."""

from __future__ import annotations

from plenarium.functions import vocab

KEYWORDS = r"\b(" + "|".join(sorted(vocab.KEYWORDS, key=lambda k: (-len(k), k))) + r")\b"
STEMS = "|".join(vocab.STEMS)

WINDOW = "coalesce(sentence_content_previous, '') || ' || ' || sentence_content_current || ' || ' || coalesce(sentence_content_next, '')"
THREE = "coalesce(sentence_content_previous, '') || ' ' || coalesce(sentence_content_current, '') || ' ' || coalesce(sentence_content_next, '')"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def array(words) -> str:
    return "[" + ", ".join(map(quoted, words)) + "]"


def within(words) -> str:
    return "(" + ", ".join(map(quoted, words)) + ")"


def any_marker(low: str, markers) -> str:
    return f"coalesce(len(list_filter({array(sorted({m.lower() for m in markers}))}, lambda m: contains({low}, m))) > 0, false)"


def hits(low: str, markers) -> str:
    return f"len(list_filter({array(sorted({m.lower() for m in markers}))}, lambda m: contains({low}, m)))"


def marker(low: str, markers) -> str:
    ordered = sorted({m.lower() for m in markers}, key=lambda m: (-len(m), m))
    return f"coalesce(list_filter({array(ordered)}, lambda m: contains({low}, m))[1], '')"


def ordered(low: str, classes: dict[str, list[str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_marker(low, m)} THEN {quoted(n)}" for n, m in classes.items() if m) + f" ELSE {quoted(default)} END"


def ordered_marker(low: str, classes: dict[str, list[str]]) -> str:
    return "CASE " + " ".join(f"WHEN {any_marker(low, m)} THEN {marker(low, m)}" for m in classes.values() if m) + " ELSE '' END"


def mode(keys: str, column: str, source: str, name: str) -> str:
    """A subquery: per ``keys`` the most frequent value, the lowest of equals, as ``name``."""
    return f"(SELECT {keys}, {column} AS {name} FROM (SELECT {keys}, {column}, count(*) AS n FROM {source} WHERE {column} IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, {column}) = 1)"


#: What may not stand beside a whole word: letters, marks, digits and the low line of any script.
EDGE = r"[^\p{L}\p{M}\p{Nd}\p{Pc}]"
GEO_CLASS = f"CASE WHEN entity_name IN {within(vocab.UNION)} THEN 'european_union' WHEN entity_name IN {within(vocab.TERRITORIES)} THEN 'territory_region' WHEN entity_name IN {within(vocab.REGIONS)} THEN 'analytical_region' ELSE 'foreign' END"
NAME = "CASE entity_content " + " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in vocab.ALIASES.items()) + " ELSE entity_content END"
DOMESTIC = " OR ".join(f"(country = {quoted(c)} AND entity_content IN {within(a)})" for c, a in vocab.DOMESTIC.items())
TOKENS = "list_filter(list_transform(regexp_extract_all(coalesce({0}, ''), '[A-Za-z][A-Za-z''-]+'), lambda t: lower(t)), lambda t: NOT list_contains(" + array(vocab.STOPWORDS) + ", t))"

#: Mentions on the topic with their annotations, as far as aggregations use them.
ANNOTATED = f"""
chosen AS (
  SELECT *, {NAME} AS entity_name, {WINDOW} AS context_window, lower({WINDOW}) AS low FROM facts
  WHERE (coalesce(debate_topic = '{vocab.TOPIC}', false) OR regexp_matches(lower({THREE}), {quoted(KEYWORDS)}))
    AND (entity_category = 'LOC' OR (entity_category = 'ORG' AND entity_content IN {within(vocab.UNION)}))
    AND NOT coalesce({DOMESTIC}, false)
),
codes AS (SELECT country_name AS entity_name, min(iso3) AS target_iso3 FROM country_list GROUP BY 1),
tokened AS (
  SELECT chosen.*, target_iso3, {GEO_CLASS} AS geo_class, cast(year(session_date) AS int) AS source_year,
    {TOKENS.format("context_window")} AS t, {TOKENS.format("entity_content")} AS e
  FROM chosen LEFT JOIN codes USING (entity_name)
),
scored AS (
  SELECT *, CASE WHEN len(t) > 0 THEN round(list_sum(list_transform(t, lambda x: CASE WHEN list_contains(e, x) THEN 50
      WHEN x IN {within(vocab.CONCRETE)} THEN 45 WHEN x IN {within(vocab.ABSTRACT)} THEN 20
      WHEN suffix(x, 'tion') OR suffix(x, 'ity') OR suffix(x, 'ism') OR suffix(x, 'ness') OR suffix(x, 'ment') THEN 26 ELSE 32 END)) / len(t) / 10, 3) END AS concreteness_score,
    list_aggregate(list_sort(list_distinct(list_filter(t, lambda x: x IN {within(vocab.CONCRETE)}))), 'string_agg', ', ') AS concrete_raw,
    list_aggregate(list_sort(list_distinct(list_filter(t, lambda x: x IN {within(vocab.ABSTRACT)}))), 'string_agg', ', ') AS abstract_raw
  FROM tokened
),
annotated AS (
  SELECT * EXCLUDE (t, e, concrete_raw, abstract_raw), len(t) AS n_tokens, coalesce(concrete_raw, '') AS concrete_words, coalesce(abstract_raw, '') AS abstract_words,
    CASE WHEN concreteness_score IS NULL THEN 'unknown' WHEN concreteness_score < 3.2 THEN 'abstract' WHEN concreteness_score >= 3.3 THEN 'concrete' ELSE 'mixed' END AS concreteness_band,
    CASE WHEN low IS NULL OR trim(low) = '' THEN 'unknown'
      WHEN {hits("low", vocab.POLICY)} = 0 AND {hits("low", vocab.SITUATION)} = 0 THEN 'neutral_reference'
      WHEN {hits("low", vocab.POLICY)} >= 2 AND {hits("low", vocab.SITUATION)} >= 2 THEN 'mixed'
      WHEN {hits("low", vocab.POLICY)} > {hits("low", vocab.SITUATION)} THEN 'policy'
      WHEN {hits("low", vocab.SITUATION)} > {hits("low", vocab.POLICY)} THEN 'situation' ELSE 'mixed' END AS ref_type,
    CASE WHEN sentence_sentiment_ana IN {within(vocab.SENTIMENTS)} THEN sentence_sentiment_ana ELSE 'unknown' END AS sentiment_level,
    CASE sentence_sentiment_ana {" ".join(f"WHEN {quoted(k)} THEN {quoted(v[0])}" for k, v in vocab.SENTIMENTS.items())} ELSE 'unknown' END AS sentiment_readable,
    CASE sentence_sentiment_ana {" ".join(f"WHEN {quoted(k)} THEN {quoted(v[1])}" for k, v in vocab.SENTIMENTS.items())} ELSE 'unknown' END AS sentiment_polarity,
    CASE WHEN geo_class <> 'foreign' THEN geo_class WHEN target_iso3 IN {within(vocab.EUROPE)} THEN 'european_country' ELSE 'non_european_country' END AS region_group,
    CASE WHEN geo_class <> 'foreign' THEN geo_class WHEN target_iso3 IN {within(vocab.WEOG)} THEN 'weog' WHEN target_iso3 IS NOT NULL THEN 'non_weog' ELSE 'unknown' END AS weog_group,
    CASE WHEN geo_class <> 'foreign' THEN geo_class WHEN target_iso3 IS NOT NULL THEN 'country' ELSE 'invalid' END AS entity_scope,
    {ordered("low", vocab.COHORTS, "unspecified")} AS migrant_cohort, {ordered_marker("low", vocab.COHORTS)} AS cohort_marker,
    {ordered("low", vocab.MEASURES, "unspecified")} AS policy_measure, {ordered_marker("low", vocab.MEASURES)} AS measure_marker,
    {ordered("low", vocab.AGENCY, "neutral_reporting")} AS policy_agency, {ordered_marker("low", vocab.AGENCY)} AS agency_marker,
    {ordered("low", vocab.FRAMES, "neutral_reporting")} AS narrative_frame, {ordered_marker("low", vocab.FRAMES)} AS frame_marker,
    CASE {" ".join(f"WHEN {ordered('low', vocab.FRAMES, 'neutral_reporting')} IN {within(fs)} THEN {quoted(p)}" for p, fs in vocab.FRAME_POLARITY.items())} ELSE 'neutral_administrative' END AS frame_polarity,
    CASE WHEN coalesce(regexp_matches(low, {quoted(rf"\b({vocab.DEFINED})\s+({vocab.DEFINES})\b")}), false) THEN 'conceptual_definition'
      WHEN {any_marker("low", vocab.CONSEQUENCE)} THEN 'argument_from_consequences' WHEN {any_marker("low", vocab.PRACTICAL)} THEN 'practical_reasoning' ELSE 'other' END AS argument_scheme,
    CASE WHEN {any_marker("low", ["come to", "arrive in", "arrival in", "into france", "to france", "in france", "france", "our country", "french territory"])}
        AND {any_marker("low", ["arrive", "arrival", "come", "enter", "into", "asylum in"])} THEN 'inbound_internal'
      WHEN {any_marker("low", ["from france", "leave france", "leaving france"])} THEN 'outbound_from_domestic'
      WHEN {any_marker("low", ["from", "to", "into", "towards", "between"])} THEN 'external_transnational' ELSE 'ambiguous' END AS migration_direction
  FROM scored
),
mentions AS (SELECT * FROM annotated WHERE (target_iso3 IS NULL OR target_iso3 <> country) AND entity_scope <> 'invalid')
"""

NORMAL = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"

#: The dyadic track: mentions resolved to countries, of speeches on the topic.
RESOLVED = f"""
short AS (SELECT iso3, min(country_name) AS short_name FROM country_list WHERE name_kind = 'short' GROUP BY 1),
given(alias, country_name) AS (VALUES {", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in vocab.RESOLVER_ALIASES.items())}),
names AS (
  SELECT country_name AS alias, country_name, iso3, cast(CASE WHEN name_kind = 'short' THEN 1.0 ELSE 0.96 END AS double) AS confidence, name_kind AS origin FROM country_list
  UNION ALL SELECT alias, country_name, iso3, 0.94, 'alias' FROM given JOIN (SELECT DISTINCT country_name, iso3 FROM country_list) USING (country_name)
),
resolver AS (
  SELECT {NORMAL.format("alias")} AS alias_normal, coalesce(short_name, country_name) AS target_name, iso3 AS target_iso3, confidence, origin
  FROM names LEFT JOIN short USING (iso3)
  QUALIFY row_number() OVER (PARTITION BY {NORMAL.format("alias")}, iso3 ORDER BY confidence DESC, alias) = 1
),
speeches AS (
  SELECT speech_id, count(*) AS n_hits FROM facts WHERE coalesce(debate_topic = '{vocab.TOPIC}', false) OR regexp_matches(lower({THREE}), '{STEMS}')
  GROUP BY 1 HAVING count(*) >= 2
),
resolved AS (
  SELECT facts.*, target_name, target_iso3 FROM facts JOIN resolver ON {NORMAL.format("entity_content")} = alias_normal
  WHERE entity_category IN ('LOC', 'ORG', 'MISC') AND target_iso3 <> country AND confidence >= 0.85 AND speech_id IN (SELECT speech_id FROM speeches)
)
"""
