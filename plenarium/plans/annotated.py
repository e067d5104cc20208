"""Queries of the annotated track over the fact table: labels of mentions, profiles, edges, examples, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenarium.functions import text as T
from plenarium.functions import vocab
from plenarium.operators import annotate as A
from plenarium.operators import answers as N
from plenarium.operators import matrix as X
from plenarium.operators import mentions as M
from plenarium.operators import profiles as P
from plenarium.plans import sqltext as S
from plenarium.sources.tables import table

EDGE = ["country", "entity_name", "target_iso3", "geo_class", "region_group", "weog_group", "source_year", "migrant_cohort", "policy_measure", "ref_type"]
AGENCY_EDGE = [*EDGE[:7], "policy_agency", *EDGE[7:]]
MODAL = ["concreteness_band", "ref_type", "sentiment_readable", "migrant_cohort", "policy_measure", "policy_agency", "narrative_frame", "frame_polarity"]
FACT_COLUMNS = """sentence_id speech_id session_date speaker_id speaker_ana country debate_topic entity_content entity_category entity_word_id
sentence_content_previous sentence_content_current sentence_content_next sentence_sentiment_value sentence_sentiment_ana""".split()
LABELS = ["ref_type", "migrant_cohort", "policy_measure", "policy_agency", "narrative_frame", "argument_scheme"]


def _facts(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "facts", *columns)


def _mentions(spark: SparkSession, folder: str) -> DataFrame:
    return A.annotated_mentions(_facts(spark, folder), table(spark, folder, "country_list"))


def a22_describe(spark, folder):
    """Rows, different sentences and speeches, first and last day of the fact table."""
    return _facts(spark, folder).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("sentence_id").alias("n_sentences"), F.count_distinct("speech_id").alias("n_speeches"), F.min("session_date").alias("first_day"), F.max("session_date").alias("last_day"))


def b1_topic_filter(spark, folder):
    return M.filter_topic(_facts(spark, folder), True, True).select("fact_id")


def b4_places(spark, folder):
    return M.filter_places(_facts(spark, folder)).select("fact_id", "entity_content")


def b5_foreign(spark, folder):
    return M.filter_foreign(_facts(spark, folder), ["Turkey", "Germany"]).groupBy("country").agg(F.count(F.lit(1)).alias("n"))


def b6_allowed(spark, folder):
    names = table(spark, folder, "country_list").select(F.col("country_name").alias("entity_content"))
    return M.filter_allowed(_facts(spark, folder), names).select("fact_id")


def b7_no_domestic(spark, folder):
    return M.drop_domestic(_facts(spark, folder)).select("fact_id")


def b18_first_per_sentence(spark, folder):
    return M.first_per(_facts(spark, folder, "fact_id", "sentence_id", "loaded_at"), ["sentence_id"], [F.col("loaded_at"), F.col("fact_id")]).select("sentence_id", "fact_id")


def b18_redelivered(spark, folder):
    """Rows without those delivered again: of rows equal but for key and load time, the first loaded."""
    facts = _facts(spark, folder)
    first = F.min(F.struct("loaded_at", "fact_id")).alias("f")
    return facts.groupBy(*FACT_COLUMNS).agg(first).select("f.fact_id")


def c1_canonical_name(spark, folder):
    return _facts(spark, folder, "entity_content").select(M.canonical_name(F.col("entity_content")).alias("entity_name")).groupBy("entity_name").agg(F.count(F.lit(1)).alias("n"))


def c_annotated_labels(spark, folder):
    """Every mention of the annotated table with its labels."""
    return _mentions(spark, folder).select(
        "fact_id", "entity_name", "target_iso3", "geo_class", "region_group", "weog_group", "entity_scope", "ref_type", "sentiment_level", "sentiment_readable", "sentiment_polarity",
        "migrant_cohort", "cohort_marker", "policy_measure", "measure_marker", "policy_agency", "agency_marker", "narrative_frame", "frame_marker", "frame_polarity", "argument_scheme", "migration_direction",
    )


def h6_concreteness(spark, folder):
    return _mentions(spark, folder).select("fact_id", "n_tokens", "concreteness_score", "concreteness_band", "concrete_words", "abstract_words")


def h4_lexicon_concreteness(spark, folder):
    """Scores by a word list made from the corpus' own country names (their letters count as scores)."""
    words = table(spark, folder, "country_list").select(F.explode(T.tokens(F.col("country_name"))).alias("word")).distinct()
    lexicon = words.withColumn("score", F.char_length("word") / 2.0)
    return A.add_lexicon_concreteness(A.with_context(_facts(spark, folder)), lexicon, "fact_id")


def c15_top_or_other(spark, folder):
    return P.top_share(_facts(spark, folder, "entity_content"), "entity_content", 10).groupBy("entity_content").agg(F.count(F.lit(1)).alias("n"))


def e1_topics(spark, folder):
    return P.distribution(_facts(spark, folder, "debate_topic"), "debate_topic", top=20)


def e2_entity_stats(spark, folder):
    return P.entity_stats(_facts(spark, folder).where("entity_content is not null"), "entity_content", "sentence_sentiment_value", 5)


def e3_distribution(spark, folder):
    return P.with_percent(P.distribution(_facts(spark, folder, "entity_category"), "entity_category"))


def e4_type_by_sentiment(spark, folder):
    return P.pivot_counts(_mentions(spark, folder), "ref_type", "sentiment_level", list(vocab.SENTIMENTS))


def e5_three_keys(spark, folder):
    return _mentions(spark, folder).groupBy("entity_name", "ref_type", "sentiment_readable").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


def e6_entity_by_sentiment(spark, folder):
    m = _mentions(spark, folder)
    top = P.distribution(m, "entity_name", top=10).select("entity_name")
    return P.pivot_counts(m.join(top, "entity_name", "left_semi"), "entity_name", "sentiment_level", list(vocab.SENTIMENTS))


def e13_diffusion_edges(spark, folder):
    return P.edges(_mentions(spark, folder), EDGE, ["cohort_marker", "measure_marker"])


def e14_agency_edges(spark, folder):
    return P.edges(_mentions(spark, folder), AGENCY_EDGE, ["agency_marker", "cohort_marker", "measure_marker"])


def e15_target_summary(spark, folder):
    return P.target_summary(e13_diffusion_edges(spark, folder), "entity_name", ["migrant_cohort", "policy_measure"])


def e16_regional_concreteness(spark, folder):
    m = _mentions(spark, folder).where("concreteness_score is not null")
    s = F.col("concreteness_score")
    return m.groupBy("region_group").agg(F.count(F.lit(1)).alias("n"), F.round(T.exact_mean(F.col("concreteness_score"), 3), 3).alias("mean_score"), F.round(F.median(s), 3).alias("median_score"), F.round(F.stddev_samp(s), 3).alias("sd_score"))


def e18_mention_profile(spark, folder):
    return P.mention_profile(_mentions(spark, folder), ["entity_name", "target_iso3", "geo_class"], MODAL, ["concrete_words", "abstract_words"], 10)


def e19_yearly_profile(spark, folder):
    return P.mention_profile(_mentions(spark, folder), ["entity_name", "source_year"], MODAL[:6], [], 1)


def e21_patterns(spark, folder):
    return _mentions(spark, folder).groupBy("narrative_frame", "argument_scheme", "policy_agency").agg(F.count(F.lit(1)).alias("n"), F.round(T.exact_mean(F.col("concreteness_score"), 3), 3).alias("mean_score"))


def e22_first_excerpt(spark, folder):
    """Per target: mentions and the excerpt of the earliest one."""
    shown = T.excerpt(F.col("context_window"), 120)
    earliest = F.min_by(shown, F.when(shown.isNotNull(), F.struct("session_date", "fact_id")))
    return _mentions(spark, folder).groupBy("entity_name").agg(F.count(F.lit(1)).alias("n"), earliest.alias("first_excerpt"))


def e24_source_summary(spark, folder):
    out = P.profile(_mentions(spark, folder), ["country"], LABELS, distinct=["speech_id", "entity_name"], means={"sentence_sentiment_value": 4, "concreteness_score": 3})
    return out.withColumnsRenamed({"n": "n_mentions", "n_speech_id": "n_speeches", "n_entity_name": "n_targets", "mean_sentence_sentiment_value": "mean_sentiment", "mean_concreteness_score": "mean_concreteness"})


def e31_top_values(spark, folder):
    return P.top_values_json(_mentions(spark, folder), "country", LABELS, 3)


def e34_crosstab(spark, folder):
    return P.pivot_counts(_mentions(spark, folder), "policy_agency", "argument_scheme", ["conceptual_definition", "argument_from_consequences", "practical_reasoning", "other"])


def e35_nested_results(spark, folder):
    """Records nested by category and entity, flat again: records and speeches per country."""
    nested = P.nested_results(_facts(spark, folder), "entity_category", ["entity_content"], ["country", "speech_id", "sentence_id", "speaker_id"])
    return P.flat_results(nested, "entity_category", ["entity_content"]).groupBy("country").agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct("speech_id").alias("n_speeches"))


def e36_value_counts(spark, folder):
    lists = P.value_list(_facts(spark, folder, "country", "debate_topic"), "country", "debate_topic")
    return lists.select("country", F.size("value_counts").cast("long").alias("n_values"), F.array_join(F.transform("value_counts", lambda x: F.concat(x["value"], F.lit(":"), x["n"].cast("string"))), ",").alias("value_counts"))


def f4_counts(spark, folder):
    w = T.three_sentences(F.col("sentence_content_previous"), F.col("sentence_content_current"), F.col("sentence_content_next"))
    return _facts(spark, folder).withColumn("w", w).select("fact_id", T.numbers(F.col("w")).alias("n_numbers"), T.years(F.col("w")).alias("n_years"), T.spaced_tokens(F.col("w")).alias("n_tokens"))


def f6_excerpt(spark, folder):
    return A.with_context(_facts(spark, folder)).select("fact_id", T.excerpt(F.col("context_window"), 100).alias("excerpt"))


def f9_lenient_dates(spark, folder):
    """Run months of task results: the date in the file name, where there is one."""
    runs = table(spark, folder, "task1_asymmetry_drivers", "run_file")
    text = F.concat(F.regexp_replace(F.regexp_extract("run_file", r"(\d{4}_\d{2})", 1), "_", "-"), F.lit("-01"))
    return runs.groupBy(T.lenient_date(text).alias("run_month")).agg(F.count(F.lit(1)).alias("n"))


def i3_concrete_events(spark, folder):
    return A.concrete_events(_mentions(spark, folder)).select("fact_id", "concreteness_score", "n_years", "excerpt")


def i2_anchors(spark, folder):
    return A.with_context(_facts(spark, folder)).select("fact_id", A.anchors(F.col("context_window")).alias("event_anchors"))


def d14_places(spark, folder):
    """Known places named in the current sentence or as the entity."""
    text = F.concat_ws(" | ", "entity_content", "sentence_content_current")
    return A.locate(_facts(spark, folder).select("fact_id", text.alias("text")), "fact_id", "text").select("fact_id", "place", "latitude", "longitude")


def j3_both_ends(spark, folder):
    m = _mentions(spark, folder).select("entity_name", "concreteness_score", "fact_id")
    return P.both_ends(m, "entity_name", "concreteness_score", "fact_id", 3)


def j4_examples(spark, folder):
    m = _mentions(spark, folder).select("country", "entity_name", "concreteness_score", "fact_id")
    return P.examples_of_frequent(m, ["country", "entity_name"], [F.desc("concreteness_score"), F.col("fact_id")], 5, 2)


def j1_share_in_source(spark, folder):
    counts = _mentions(spark, folder).groupBy("country", "policy_agency").agg(F.count(F.lit(1)).alias("n"))
    return P.with_percent(counts, ["country"])


def k1_sample(spark, folder):
    return P.sample_rows(_facts(spark, folder, "fact_id", "entity_content").where("entity_content = 'Turkey'"), "fact_id", 50)


def k2_sample_per_country(spark, folder):
    return P.sample_per_stratum(_facts(spark, folder, "fact_id", "country"), ["country"], "fact_id", 5)


def k3_sample_per_cell(spark, folder):
    return P.sample_per_stratum(_mentions(spark, folder).select("fact_id", "country", "policy_agency"), ["country", "policy_agency"], "fact_id", 2)


def n2_prompt_evidence(spark, folder):
    return N.prompt_evidence(_facts(spark, folder), "country", "fact_id", 3)


def n5_repaired_answers(spark, folder):
    return N.repaired(table(spark, folder, "task_runs"), "body")


def n7_reclassify(spark, folder):
    """Pairs with enough mentions to be classified again, with their usual agency."""
    m = _mentions(spark, folder)
    return m.groupBy("country", "entity_name").agg(F.count(F.lit(1)).alias("n"), F.mode("policy_agency", deterministic=True).alias("policy_agency")).where("n >= 15")


def m17_policy_similarity(spark, folder):
    """Cosine of the parliaments' cohort × measure profiles."""
    m = _mentions(spark, folder).select("country", F.concat_ws(" / ", "migrant_cohort", "policy_measure").alias("cell"))
    counts = m.groupBy("country", F.col("cell").alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return X.cosine(X.complete(counts, "country"), "country", "value").select("a", "b", F.round("similarity", 6).alias("similarity"))


def m20_density(spark, folder):
    return X.binned_density(_mentions(spark, folder), "region_group", "concreteness_score", 2.0, 5.0, 12)


def v6_polarity_shares(spark, folder):
    """Shares of positive, neutral and negative sentiment per target with at least 10 mentions."""
    p = F.col("sentiment_polarity")
    out = _mentions(spark, folder).groupBy("entity_name").agg(F.count_if(p == "positive").alias("n_positive"), F.count_if(p == "neutral").alias("n_neutral"), F.count_if(p == "negative").alias("n_negative"))
    total = F.col("n_positive") + F.col("n_neutral") + F.col("n_negative")
    return out.where(total >= 10).withColumns({"share_positive": F.col("n_positive") / total, "share_negative": F.col("n_negative") / total})


def v7_links(spark, folder):
    """Source to agency and agency to target, as one list of links."""
    m = _mentions(spark, folder)
    left = m.groupBy(F.col("country").alias("source"), F.col("policy_agency").alias("target")).agg(F.count(F.lit(1)).alias("value"))
    right = m.groupBy(F.col("policy_agency").alias("source"), F.col("entity_name").alias("target")).agg(F.count(F.lit(1)).alias("value"))
    return left.unionByName(right)


def z_scalar_check(spark, folder):
    """String, date, number and null functions over documents."""
    d = table(spark, folder, "documents")
    t = F.col("text")
    return d.select(
        "doc_id", F.char_length(t).cast("long").alias("n_letters"), F.lower(F.substring(t, 1, 10)).alias("head"), F.coalesce(F.startswith(t, F.lit("The")), F.lit(False)).alias("begins_the"),
        F.year("session_date").cast("long").alias("year"), F.date_add("session_date", 90).alias("later"), F.greatest(F.col("n_chars"), F.lit(100)).alias("at_least"), F.coalesce(F.nullif(F.trim("debate_topic"), F.lit("")), F.lit("missing")).alias("topic"),
        F.round(F.log1p(F.col("n_chars").cast("double")), 6).alias("log_chars"),
    )


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and n[0] != "_"}

_W = f"WITH {S.ANNOTATED}"
_MODE = lambda keys, cols, src="mentions": "".join(f" LEFT JOIN {S.mode(keys, c, src, 'dominant_' + c)} m{i} ON " + " AND ".join(f"g.{k.strip()} IS NOT DISTINCT FROM m{i}.{k.strip()}" for k in keys.split(",")) for i, c in enumerate(cols))
_DOM = lambda cols: ", ".join(f"m{i}.dominant_{c}" for i, c in enumerate(cols))
_JOINED = lambda c, n: f"string_agg(DISTINCT {c}, ', ' ORDER BY {c}) AS {n}"
_SENT = ", ".join(f"count(*) FILTER (sentiment_level = '{x}') AS {x.replace(':', '_')}" for x in vocab.SENTIMENTS)
_EXCERPT = "CASE WHEN len({0}) > {1} THEN rtrim(substring({0}, 1, {1} - 3)) || '...' ELSE {0} END"
_COMPACT = r"trim(regexp_replace(replace(context_window, '||', ' '), '\s+', ' ', 'g'))"
_EDGES = _W + f", edges AS (SELECT {', '.join(EDGE)}, count(*) AS weight, count(DISTINCT sentence_id) AS n_sentences, {_JOINED('cohort_marker', 'cohort_markers')}, {_JOINED('measure_marker', 'measure_markers')} FROM mentions GROUP BY {', '.join(EDGE)})"
_LABELS = "fact_id, entity_name, target_iso3, geo_class, region_group, weog_group, entity_scope, ref_type, sentiment_level, sentiment_readable, sentiment_polarity, migrant_cohort, cohort_marker, policy_measure, measure_marker, policy_agency, agency_marker, narrative_frame, frame_marker, frame_polarity, argument_scheme, migration_direction"


ORACLE = {
    "a22_describe": "SELECT count(*) AS n_rows, count(DISTINCT sentence_id) AS n_sentences, count(DISTINCT speech_id) AS n_speeches, min(session_date) AS first_day, max(session_date) AS last_day FROM facts",
    "b1_topic_filter": f"SELECT fact_id FROM facts WHERE coalesce(debate_topic = '{vocab.TOPIC}', false) OR regexp_matches(lower({S.THREE}), {S.quoted(S.KEYWORDS)})",
    "b4_places": "SELECT fact_id, entity_content FROM facts WHERE entity_category = 'LOC' OR (entity_category = 'ORG' AND entity_content IN ('European Union', 'EU'))",
    "b5_foreign": "SELECT country, count(*) AS n FROM facts WHERE entity_content NOT IN ('Turkey', 'Germany') GROUP BY 1",
    "b6_allowed": "SELECT fact_id FROM facts WHERE entity_content IN (SELECT country_name FROM country_list)",
    "b7_no_domestic": f"SELECT fact_id FROM facts WHERE NOT coalesce({S.DOMESTIC}, false)",
    "b18_first_per_sentence": "SELECT sentence_id, fact_id FROM facts QUALIFY row_number() OVER (PARTITION BY sentence_id ORDER BY loaded_at, fact_id) = 1",
    "b18_redelivered": f"SELECT fact_id FROM (SELECT fact_id, row_number() OVER (PARTITION BY {', '.join(FACT_COLUMNS)} ORDER BY loaded_at, fact_id) AS i FROM facts) WHERE i = 1",
    "c1_canonical_name": f"SELECT {S.NAME} AS entity_name, count(*) AS n FROM facts GROUP BY 1",
    "c_annotated_labels": _W + f" SELECT {_LABELS} FROM mentions",
    "h6_concreteness": _W + " SELECT fact_id, n_tokens, concreteness_score, concreteness_band, concrete_words, abstract_words FROM mentions",
    "h4_lexicon_concreteness": f"""WITH lex AS (SELECT DISTINCT w, len(w) / 2.0 AS score FROM (SELECT unnest({S.TOKENS.format("country_name")}) AS w FROM country_list)),
        t AS (SELECT fact_id, unnest({S.TOKENS.format(S.WINDOW)}) AS w FROM facts), s AS (SELECT fact_id, round(avg(score), 3) AS concreteness_score FROM t JOIN lex USING (w) GROUP BY 1)
        SELECT fact_id, concreteness_score FROM facts LEFT JOIN s USING (fact_id)""",
    "c15_top_or_other": """WITH top AS (SELECT entity_content FROM facts WHERE entity_content IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10)
        SELECT CASE WHEN entity_content IN (SELECT entity_content FROM top) THEN entity_content ELSE 'other' END AS entity_content, count(*) AS n FROM facts GROUP BY 1""",
    "e1_topics": "SELECT debate_topic, count(*) AS n FROM facts GROUP BY 1 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 20",
    "e2_entity_stats": "SELECT entity_content, count(*) AS n, round(avg(cast(round(sentence_sentiment_value * 10000) AS bigint)) / 10000, 3) AS mean_value, round(stddev_samp(sentence_sentiment_value), 3) AS sd_value, min(sentence_sentiment_value) AS min_value, max(sentence_sentiment_value) AS max_value FROM facts WHERE entity_content IS NOT NULL GROUP BY 1 HAVING count(*) >= 5",
    "e3_distribution": "SELECT entity_category, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER () AS percent FROM facts GROUP BY 1",
    "e4_type_by_sentiment": _W + f" SELECT ref_type, {_SENT} FROM mentions GROUP BY 1",
    "e5_three_keys": _W + " SELECT entity_name, ref_type, sentiment_readable, count(*) AS n FROM mentions GROUP BY 1, 2, 3 HAVING count(*) >= 3",
    "e6_entity_by_sentiment": _W + f", top AS (SELECT entity_name FROM mentions GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10) SELECT entity_name, {_SENT} FROM mentions WHERE entity_name IN (SELECT entity_name FROM top) GROUP BY 1",
    "e13_diffusion_edges": _EDGES + " SELECT * FROM edges",
    "e14_agency_edges": _W + f" SELECT {', '.join(AGENCY_EDGE)}, count(*) AS weight, count(DISTINCT sentence_id) AS n_sentences, {_JOINED('agency_marker', 'agency_markers')}, {_JOINED('cohort_marker', 'cohort_markers')}, {_JOINED('measure_marker', 'measure_markers')} FROM mentions GROUP BY {', '.join(AGENCY_EDGE)}",
    "e15_target_summary": _EDGES + ", g AS (SELECT entity_name, cast(sum(weight) AS bigint) AS total_weight, count(*) AS n_edges FROM edges GROUP BY 1) SELECT g.*, " + _DOM(["migrant_cohort", "policy_measure"]) + " FROM g" + _MODE("entity_name", ["migrant_cohort", "policy_measure"], "edges"),
    "e16_regional_concreteness": _W + " SELECT region_group, count(*) AS n, round(avg(cast(round(concreteness_score * 1000) AS bigint)) / 1000, 3) AS mean_score, round(median(concreteness_score), 3) AS median_score, round(stddev_samp(concreteness_score), 3) AS sd_score FROM mentions WHERE concreteness_score IS NOT NULL GROUP BY 1",
    "e18_mention_profile": _W + f", g AS (SELECT entity_name, target_iso3, geo_class, count(*) AS n_mentions, min(source_year) AS first_year, max(source_year) AS last_year, round(avg(cast(round(concreteness_score * 1000) AS bigint)) / 1000, 3) AS mean_concreteness, {_JOINED('concrete_words', 'concrete_words_seen')}, {_JOINED('abstract_words', 'abstract_words_seen')} FROM mentions GROUP BY 1, 2, 3 HAVING count(*) >= 10) SELECT g.*, " + _DOM(MODAL) + " FROM g" + _MODE("entity_name, target_iso3, geo_class", MODAL),
    "e19_yearly_profile": _W + ", g AS (SELECT entity_name, source_year, count(*) AS n_mentions, min(source_year) AS first_year, max(source_year) AS last_year, round(avg(cast(round(concreteness_score * 1000) AS bigint)) / 1000, 3) AS mean_concreteness FROM mentions GROUP BY 1, 2) SELECT g.*, " + _DOM(MODAL[:6]) + " FROM g" + _MODE("entity_name, source_year", MODAL[:6]),
    "e21_patterns": _W + " SELECT narrative_frame, argument_scheme, policy_agency, count(*) AS n, round(avg(cast(round(concreteness_score * 1000) AS bigint)) / 1000, 3) AS mean_score FROM mentions GROUP BY 1, 2, 3",
    "e22_first_excerpt": _W + ", c AS (SELECT *, " + _COMPACT + " AS short FROM mentions) SELECT entity_name, count(*) AS n, arg_min(" + _EXCERPT.format("short", 120) + ", {'d': session_date, 'f': fact_id}) AS first_excerpt FROM c GROUP BY 1",
    "e24_source_summary": _W + ", g AS (SELECT country, count(*) AS n_mentions, count(DISTINCT speech_id) AS n_speeches, count(DISTINCT entity_name) AS n_targets, avg(cast(round(sentence_sentiment_value * 10000) AS bigint)) / 10000 AS mean_sentiment, avg(cast(round(concreteness_score * 1000) AS bigint)) / 1000 AS mean_concreteness FROM mentions GROUP BY 1) SELECT g.*, " + _DOM(LABELS) + " FROM g" + _MODE("country", LABELS),
    "e34_crosstab": _W + " SELECT policy_agency, " + ", ".join(f"count(*) FILTER (argument_scheme = '{x}') AS {x}" for x in ("conceptual_definition", "argument_from_consequences", "practical_reasoning", "other")) + " FROM mentions GROUP BY 1",
    "e35_nested_results": "SELECT country, count(*) AS n_records, count(DISTINCT speech_id) AS n_speeches FROM (SELECT DISTINCT entity_category, entity_content, country, speech_id, sentence_id, speaker_id FROM facts) GROUP BY 1",
    "e36_value_counts": "SELECT country, count(*) AS n_values, string_agg(debate_topic || ':' || n, ',' ORDER BY n DESC, debate_topic) AS value_counts FROM (SELECT country, debate_topic, count(*) AS n FROM facts WHERE debate_topic IS NOT NULL GROUP BY 1, 2) GROUP BY 1",
    "f4_counts": rf"SELECT fact_id, len(regexp_extract_all(w, '\b\d+([.,]\d+)?\b')) AS n_numbers, len(regexp_extract_all(w, '\b(19|20)\d{{2}}\b')) AS n_years, len(string_split(w, ' ')) AS n_tokens FROM (SELECT fact_id, {S.THREE} AS w FROM facts)",
    "f6_excerpt": "SELECT fact_id, " + _EXCERPT.format("short", 100) + " AS excerpt FROM (SELECT fact_id, " + _COMPACT + " AS short FROM (SELECT fact_id, " + S.WINDOW + " AS context_window FROM facts))",
    "f9_lenient_dates": r"SELECT try_cast(replace(regexp_extract(run_file, '(\d{4}_\d{2})', 1), '_', '-') || '-01' AS date) AS run_month, count(*) AS n FROM task1_asymmetry_drivers GROUP BY 1",
    "i3_concrete_events": _W + r", c AS (SELECT *, " + _COMPACT + r" AS short FROM mentions WHERE concreteness_score >= 3.3) SELECT fact_id, concreteness_score, len(regexp_extract_all(context_window, '\b(19|20)\d{2}\b')) AS n_years, " + _EXCERPT.format("short", 360) + " AS excerpt FROM c",
    "d14_places": " UNION ALL ".join(
        f"SELECT fact_id, {S.quoted(n)} AS place, cast({lat} AS double) AS latitude, cast({lon} AS double) AS longitude FROM facts WHERE "
        + "regexp_matches(concat_ws(' | ', entity_content, sentence_content_current), " + S.quoted(rf"(^|{S.EDGE})(" + "|".join(names) + rf")({S.EDGE}|$)") + ")"
        for n, names, lat, lon, _ in vocab.PLACES
    ),
    "j3_both_ends": _W + """, r AS (SELECT entity_name, concreteness_score, fact_id FROM mentions WHERE concreteness_score IS NOT NULL)
        SELECT *, row_number() OVER (PARTITION BY entity_name ORDER BY concreteness_score DESC, fact_id) AS place, 'highest' AS example_type FROM r QUALIFY place <= 3
        UNION ALL SELECT *, row_number() OVER (PARTITION BY entity_name ORDER BY concreteness_score, fact_id) AS place, 'lowest' FROM r QUALIFY place <= 3""",
    "j4_examples": _W + " SELECT country, entity_name, concreteness_score, fact_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY country, entity_name) AS pair_count FROM mentions WINDOW w AS (PARTITION BY country, entity_name ORDER BY concreteness_score DESC NULLS LAST, fact_id) QUALIFY place <= 2 AND pair_count >= 5",
    "j1_share_in_source": _W + " SELECT country, policy_agency, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY country) AS percent FROM mentions GROUP BY 1, 2",
    "k1_sample": "SELECT fact_id, entity_content FROM facts WHERE entity_content = 'Turkey' ORDER BY md5(cast(fact_id AS varchar) || '42'), fact_id LIMIT 50",
    "k2_sample_per_country": "SELECT fact_id, country FROM facts QUALIFY row_number() OVER (PARTITION BY country ORDER BY md5(cast(fact_id AS varchar) || '42'), fact_id) <= 5",
    "k3_sample_per_cell": _W + " SELECT fact_id, country, policy_agency FROM mentions QUALIFY row_number() OVER (PARTITION BY country, policy_agency ORDER BY md5(cast(fact_id AS varchar) || '42'), fact_id) <= 2",
    "n2_prompt_evidence": """WITH s AS (SELECT * FROM facts WHERE sentence_content_current IS NOT NULL QUALIFY row_number() OVER (PARTITION BY country ORDER BY md5(cast(fact_id AS varchar) || '42'), fact_id) <= 3)
        SELECT country, string_agg('prev: ' || substring(coalesce(sentence_content_previous, ''), 1, 300) || ' | cur: ' || substring(sentence_content_current, 1, 300) || ' | next: ' || substring(coalesce(sentence_content_next, ''), 1, 300), chr(10) ORDER BY md5(cast(fact_id AS varchar) || '42'), fact_id) AS evidence, count(*) AS n_snippets FROM s GROUP BY 1""",
    "n7_reclassify": _W + ", g AS (SELECT country, entity_name, count(*) AS n FROM mentions GROUP BY 1, 2 HAVING count(*) >= 15) SELECT g.*, m0.dominant_policy_agency AS policy_agency FROM g" + _MODE("country, entity_name", ["policy_agency"]),
    "m17_policy_similarity": _W + """, c AS (SELECT country, migrant_cohort || ' / ' || policy_measure AS feature, count(*) AS v FROM mentions GROUP BY 1, 2), n AS (SELECT country, sqrt(sum(v * v)) AS n FROM c GROUP BY 1),
        p AS (SELECT x.country AS a, y.country AS b FROM n x JOIN n y ON x.country < y.country),
        d AS (SELECT x.country AS a, y.country AS b, sum(x.v * y.v) AS s FROM c x JOIN c y ON x.feature = y.feature AND x.country < y.country GROUP BY 1, 2)
        SELECT p.a, p.b, round(least(1.0, coalesce(s, 0) / (na.n * nb.n)), 6) AS similarity FROM p LEFT JOIN d USING (a, b) JOIN n na ON na.country = p.a JOIN n nb ON nb.country = p.b""",
    "m20_density": _W + ", b AS (SELECT region_group, cast(greatest(0, least(11, floor((concreteness_score - 2.0) / 3.0 * 12))) AS int) AS bin, count(*) AS n FROM mentions WHERE concreteness_score IS NOT NULL GROUP BY 1, 2) SELECT *, n / sum(n) OVER (PARTITION BY region_group) AS share FROM b",
    "v6_polarity_shares": _W + """, g AS (SELECT entity_name, count(*) FILTER (sentiment_polarity = 'positive') AS n_positive, count(*) FILTER (sentiment_polarity = 'neutral') AS n_neutral, count(*) FILTER (sentiment_polarity = 'negative') AS n_negative FROM mentions GROUP BY 1)
        SELECT *, n_positive / (n_positive + n_neutral + n_negative) AS share_positive, n_negative / (n_positive + n_neutral + n_negative) AS share_negative FROM g WHERE n_positive + n_neutral + n_negative >= 10""",
    "v7_links": _W + " SELECT country AS source, policy_agency AS target, count(*) AS value FROM mentions GROUP BY 1, 2 UNION ALL SELECT policy_agency, entity_name, count(*) FROM mentions GROUP BY 1, 2",
    "z_scalar_check": """SELECT doc_id, len(text) AS n_letters, lower(substring(text, 1, 10)) AS head, coalesce(starts_with(text, 'The'), false) AS begins_the, year(session_date) AS year, cast(session_date + 90 AS date) AS later,
        greatest(n_chars, 100) AS at_least, coalesce(nullif(trim(debate_topic), ''), 'missing') AS topic, round(ln(1 + n_chars), 6) AS log_chars FROM documents""",
}
