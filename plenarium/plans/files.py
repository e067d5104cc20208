"""Queries that read and reshape tables as files do: unions, late-bound columns, nested documents, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenarium.lineage import shared_folder
from plenarium.operators import answers as N
from plenarium.sources import files as S
from plenarium.sources.tables import table


def a10_union_relaxed(spark, folder):
    """All task results as one table: columns by name, nulls where a task lacks one; rows per task and file."""
    tasks = ("task1_asymmetry_drivers", "task2_extracted_events", "task5_direction_framing", "task6_policy_convergence")
    all_rows = S.union_relaxed([table(spark, folder, t).withColumn("task", F.lit(t)) for t in tasks])
    return all_rows.groupBy("task", "run_file").agg(F.count(F.lit(1)).alias("n_rows"), F.count("year").alias("n_years"), F.count("rationale").alias("n_rationales"), F.sum("n_mentions").alias("n_mentions"))


def a23_late_bound(spark, folder):
    """The frame of the direction framings under whichever name a file has it."""
    df = table(spark, folder, "task5_direction_framing")
    frame = F.coalesce(*[F.col(c) for c in N.OTHER_NAMES["frame"] if c in df.columns])
    where = S.first_column(df, ["parliament", "country"])
    return df.groupBy(where, N.allowed(frame, ["security_threat", "humanitarian_responsibility", "economic_contribution", "capacity_pressure", "administrative_management"]).alias("frame")).agg(F.count(F.lit(1)).alias("n"))


def a16_nested_json(spark, folder):
    """A JSON document per country with the people in it."""
    return S.nested_json(table(spark, folder, "people").where("country is not null"), "country", ["speaker_id", "gender"]).select("country", F.char_length("document").cast("long").alias("n_letters"))


def a21_schema(spark, folder):
    return S.schema_summary(table(spark, folder, "facts"))


def j14_coalesced_use(spark, folder):
    """Evidence use under either of its names, by country and year."""
    df = table(spark, folder, "task2_extracted_events")
    use = F.coalesce("evidentiary_use", "evidenti_use")
    return df.groupBy("country", "year", F.coalesce(F.nullif(F.trim(use), F.lit("")), F.lit("missing")).alias("evidence_use")).agg(F.count(F.lit(1)).alias("n"))


def c17_safe_label(spark, folder):
    label = F.coalesce(F.nullif(F.trim("primary_driver"), F.lit("")), F.lit("missing"))
    return table(spark, folder, "task1_asymmetry_drivers").groupBy(label.alias("driver")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("ratio")).alias("mean_ratio"), F.max("n_forward").alias("most"))


def _fact_files(spark, folder):
    root = shared_folder(spark)
    S.write_fact_files(table(spark, folder, "facts"), root)
    return root


def _n():
    return F.count(F.lit(1)).alias("n")


def a1_country_year(spark, folder):
    """One country and year (the first of both) from files laid out by both."""
    root = _fact_files(spark, folder)
    country, year = S.discover(spark, root)[0].rsplit("/", 1)[1].split("_")[:2]
    return S.read_facts(spark, root, country, [int(year)]).groupBy("country", "source_year", "entity_category").agg(_n())


def a2_several_years(spark, folder):
    """The first years of a country, all of which have to be there."""
    root = _fact_files(spark, folder)
    years = sorted(int(p.rsplit("_", 2)[1]) for p in S.discover(spark, root, "TUR"))[:3]
    return S.read_facts(spark, root, "TUR", years).groupBy("country", "source_year").agg(_n())


def a3_discovery(spark, folder):
    """The fact files there are."""
    paths = S.discover(spark, _fact_files(spark, folder))
    return spark.createDataFrame([("/".join(p.split("/")[-2:]),) for p in paths], "file string")


def a5_all_countries(spark, folder):
    return S.read_facts(spark, _fact_files(spark, folder)).groupBy("country", "source_year").agg(_n(), F.count_distinct("speech_id").alias("n_speeches"))


def a6_former_name(spark, folder):
    """A table that may have a former name."""
    return S.read_first(spark, f"{folder}/members.parquet", f"{folder}/people.parquet").groupBy("gender").agg(_n())


def a7_glob(spark, folder):
    return spark.read.parquet(f"{_fact_files(spark, folder)}/*/*_facts.parquet").groupBy("debate_topic").agg(_n())


def a8_csv(spark, folder):
    """A table as CSV and back, with its types."""
    people, path = table(spark, folder, "people"), f"{shared_folder(spark)}/people.csv"
    S.write_table(people, path, "csv")
    return S.read_any(spark, path, people.schema).groupBy("country", F.year("member_since").alias("since")).agg(_n(), F.sum("birth_year").alias("birth_years"))


def a12_csv_union(spark, folder):
    """CSV files of many sources as one table, with the source from the name."""
    people, path = table(spark, folder, "people").where("country is not null"), f"{shared_folder(spark)}/people"
    S.write_table(people.withColumn("source", F.col("country")), path, "csv", ["source"])
    return S.with_source(S.read_any(spark, f"{path}/source=*/*.csv", people.schema), "source_country", r"/source=([A-Z]{3})/").groupBy("source_country", "gender").agg(_n())


def a13_lexicon(spark, folder):
    """A word list as CSV, read again."""
    path = f"{shared_folder(spark)}/words.csv"
    words = table(spark, folder, "country_list").select(F.col("country_name").alias("Word"), F.char_length("country_name").cast("string").alias("Conc.M"))
    S.write_table(words.where("Word <> ''"), path, "csv")
    return S.read_lexicon(spark, path)


def a14_parquet(spark, folder):
    """A table laid out in folders by country; a filter reads one of them."""
    path = f"{shared_folder(spark)}/facts"
    S.write_table(table(spark, folder, "facts", "fact_id", "country", "debate_topic"), path, by=["country"])
    return spark.read.parquet(path).where("country = 'POL'").groupBy("debate_topic").agg(_n())


def a18_csv_safe(spark, folder):
    """Lists and structs as text in CSV."""
    path = f"{shared_folder(spark)}/nested.csv"
    S.write_table(table(spark, folder, "people").groupBy("country").agg(F.array_sort(F.collect_set("gender")).alias("genders")), path, "csv")
    return S.read_any(spark, path, "country string, genders string")


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and n[1:2].isdigit()}

_KINDS = {"LongType()": "bigint", "StringType()": "string", "DateType()": "date", "DoubleType()": "double"}
ORACLE = {
    "a1_country_year": "SELECT country, cast(year(session_date) AS int) AS source_year, entity_category, count(*) AS n FROM facts WHERE (country, year(session_date)) IN (SELECT (country, year(session_date)) FROM facts WHERE country IS NOT NULL AND session_date IS NOT NULL ORDER BY country, year(session_date) LIMIT 1) GROUP BY 1, 2, 3",
    "a2_several_years": "SELECT country, cast(year(session_date) AS int) AS source_year, count(*) AS n FROM facts WHERE country = 'TUR' AND year(session_date) IN (SELECT DISTINCT year(session_date) FROM facts WHERE country = 'TUR' AND session_date IS NOT NULL ORDER BY 1 LIMIT 3) GROUP BY 1, 2",
    "a3_discovery": "SELECT DISTINCT country || '/' || country || '_' || year(session_date) || '_facts.parquet' AS file FROM facts WHERE country IS NOT NULL AND session_date IS NOT NULL",
    "a5_all_countries": "SELECT country, cast(year(session_date) AS int) AS source_year, count(*) AS n, count(DISTINCT speech_id) AS n_speeches FROM facts WHERE country IS NOT NULL AND session_date IS NOT NULL GROUP BY 1, 2",
    "a6_former_name": "SELECT gender, count(*) AS n FROM people GROUP BY 1",
    "a7_glob": "SELECT debate_topic, count(*) AS n FROM facts WHERE country IS NOT NULL AND session_date IS NOT NULL GROUP BY 1",
    "a8_csv": "SELECT country, cast(year(member_since) AS int) AS since, count(*) AS n, cast(sum(birth_year) AS bigint) AS birth_years FROM people GROUP BY 1, 2",
    "a12_csv_union": "SELECT country AS source_country, gender, count(*) AS n FROM people WHERE country IS NOT NULL GROUP BY 1, 2",
    "a13_lexicon": "SELECT DISTINCT lower(trim(country_name)) AS word, cast(len(country_name) AS double) AS score FROM country_list WHERE country_name <> ''",
    "a14_parquet": "SELECT debate_topic, count(*) AS n FROM facts WHERE country = 'POL' GROUP BY 1",
    "a18_csv_safe": """SELECT country, '[' || coalesce(string_agg(DISTINCT '"' || gender || '"', ',' ORDER BY '"' || gender || '"'), '') || ']' AS genders FROM people GROUP BY 1""",
    "a21_schema": " UNION ALL ".join(f"SELECT '{f.name}' AS \"column\", '{_KINDS.get(str(f.dataType), 'timestamp')}' AS kind, count(*) AS n_rows, count(*) - count({f.name}) AS n_nulls FROM facts" for f in S.FACTS),
    "a16_nested_json": """WITH r AS (SELECT DISTINCT country, speaker_id, gender FROM people WHERE country IS NOT NULL)
        SELECT country, len('{"country":"' || country || '","records":[]}') + sum(len('{' || concat_ws(',', '"speaker_id":"' || speaker_id || '"', '"gender":"' || gender || '"') || '}')) + count(*) - 1 AS n_letters FROM r GROUP BY country""",
    "a10_union_relaxed": """
        SELECT task, run_file, count(*) AS n_rows, count(year) AS n_years, count(rationale) AS n_rationales, cast(sum(n_mentions) AS bigint) AS n_mentions FROM (
        SELECT 'task1_asymmetry_drivers' AS task, * FROM task1_asymmetry_drivers UNION ALL BY NAME SELECT 'task2_extracted_events' AS task, * FROM task2_extracted_events
        UNION ALL BY NAME SELECT 'task5_direction_framing' AS task, * FROM task5_direction_framing UNION ALL BY NAME SELECT 'task6_policy_convergence' AS task, * FROM task6_policy_convergence) GROUP BY 1, 2""",
    "a23_late_bound": r"""
        WITH f AS (SELECT parliament, regexp_replace(lower(trim(coalesce(dominant_framing, dominant_frame))), '[\s-]+', '_', 'g') AS x FROM task5_direction_framing)
        SELECT parliament, CASE WHEN x IN ('security_threat', 'humanitarian_responsibility', 'economic_contribution', 'capacity_pressure', 'administrative_management') THEN x END AS frame, count(*) AS n FROM f GROUP BY 1, 2""",
    "j14_coalesced_use": "SELECT country, year, coalesce(nullif(trim(coalesce(evidentiary_use, evidenti_use)), ''), 'missing') AS evidence_use, count(*) AS n FROM task2_extracted_events GROUP BY 1, 2, 3",
    "c17_safe_label": "SELECT coalesce(nullif(trim(primary_driver), ''), 'missing') AS driver, count(*) AS n, avg(ratio) AS mean_ratio, max(n_forward) AS most FROM task1_asymmetry_drivers GROUP BY 1",
}
