"""Sources and sinks: discovery of fact files, unions of drifting files, word lists, text sinks, graphs."""

from __future__ import annotations

import os
import re
from functools import reduce
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FACTS = T.StructType(
    [
        T.StructField("fact_id", T.LongType()),
        T.StructField("sentence_id", T.StringType()),
        T.StructField("speech_id", T.StringType()),
        T.StructField("session_date", T.DateType()),
        T.StructField("speaker_id", T.StringType()),
        T.StructField("speaker_ana", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("debate_topic", T.StringType()),
        T.StructField("entity_content", T.StringType()),
        T.StructField("entity_category", T.StringType()),
        T.StructField("entity_word_id", T.StringType()),
        T.StructField("sentence_content_previous", T.StringType()),
        T.StructField("sentence_content_current", T.StringType()),
        T.StructField("sentence_content_next", T.StringType()),
        T.StructField("sentence_sentiment_value", T.DoubleType()),
        T.StructField("sentence_sentiment_ana", T.StringType()),
        T.StructField("loaded_at", T.TimestampType()),
    ]
)
#: Nodes and edges of a graph file; larger graphs are tables.
MAX_GRAPH = 100_000


def fact_path(root: str, country: str, year: int) -> str:
    return f"{root}/{country}/{country}_{year}_facts.parquet"


def _paths(spark: SparkSession, pattern: str) -> list[str]:
    """Files (or folders) that match, by the file system of the pattern."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or [])


def discover(spark: SparkSession, root: str, country: str = "*", years: list[int] | None = None) -> list[str]:
    """Paths of the fact files of a country (or all), of some years or all. Only the chosen files are ever opened."""
    year = lambda p: int(re.search(r"_(\d{4})_facts", p)[1])
    return [p for p in _paths(spark, f"{root}/{country}/*_*_facts.parquet") if years is None or year(p) in years]


def read_facts(spark: SparkSession, root: str, country: str = "*", years: list[int] | None = None, schema: T.StructType | None = FACTS) -> DataFrame:
    """One table of many fact files with ``source_year`` from the file name. Asked-for years of a country that are
    missing are all named in one error. One scan; predicates and columns reach it."""
    paths = discover(spark, root, country, years)
    if years is not None and country != "*":
        missing = [fact_path(root, country, y) for y in years if not any(p.endswith(f"/{country}_{y}_facts.parquet") for p in paths)]
        if missing:
            raise FileNotFoundError("missing: " + ", ".join(missing))
    if not paths:
        raise FileNotFoundError(f"no fact files for {country} in {root}")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(*paths).withColumn("source_year", F.regexp_extract(F.col("_metadata.file_path"), r"_(\d{4})_facts", 1).cast("int"))


def write_fact_files(facts: DataFrame, root: str) -> None:
    """Facts as ``<root>/<ISO3>/<ISO3>_<year>_facts.parquet``, as ``read_facts`` finds them. Rows without a country or a date
    belong to no file. Rows are rebalanced by country and year, large ones over several tasks; the folders get their
    names afterwards."""
    keyed = facts.where("country is not null and session_date is not null").withColumns({"__c": F.col("country"), "__y": F.year("session_date")})
    keyed.hint("rebalance", F.col("__c"), F.col("__y")).write.partitionBy("__c", "__y").parquet(f"{root}/_written")
    jvm = facts.sparkSession._jvm
    for found in _paths(facts.sparkSession, f"{root}/_written/__c=*/__y=*"):
        country, year = re.search(r"__c=([^/]*)/__y=([^/]*)", found).groups()
        to, source = jvm.org.apache.hadoop.fs.Path(fact_path(root, country, int(year))), jvm.org.apache.hadoop.fs.Path(found)
        system = source.getFileSystem(facts.sparkSession._jsc.hadoopConfiguration())
        system.mkdirs(to.getParent())
        if not system.rename(source, to):
            raise OSError(f"{found} could not be renamed")


def read_first(spark: SparkSession, *paths: str) -> DataFrame:
    """The first of several files that is there (a table with a former name)."""
    for p in paths:
        if _paths(spark, p):
            return spark.read.parquet(p)
    raise FileNotFoundError(" or ".join(paths))


def read_any(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet, CSV, TSV or JSON lines by the ending of the name. Text formats need a schema, else all is text."""
    end = os.path.splitext(path)[1].lower()
    if end == ".parquet":
        return spark.read.parquet(path)
    if end in (".csv", ".tsv"):
        reader = spark.read.option("header", True).option("sep", "\t" if end == ".tsv" else ",").option("multiLine", True).option("escape", '"')
        return (reader.schema(schema) if schema is not None else reader).csv(path)
    if end in (".json", ".jsonl"):
        return (spark.read.schema(schema) if schema is not None else spark.read.option("primitivesAsString", True)).json(path)
    raise ValueError(f"unknown kind of file: {path}")


def union_relaxed(parts: list[DataFrame]) -> DataFrame:
    """All rows under all columns by name, null where a part lacks one; columns of different types become text, whole
    and fractional numbers fractional."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    kinds: dict[str, set[str]] = {}
    for p in parts:
        for c, k in p.dtypes:
            kinds.setdefault(c, set()).add(k)

    def common(found: set[str]) -> str | None:
        if len(found) == 1:
            return None
        if found <= set(numeric):
            return "double" if found & {"float", "double"} else "bigint"
        return "string"

    cast = {c: common(k) for c, k in kinds.items()}
    aligned = [p.withColumns({c: F.col(c).cast(cast[c]) for c in p.columns if cast[c]}) for p in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aligned)


def with_source(df: DataFrame, column: str = "source_country", pattern: str = r"/([A-Z]{3})_[^/]*(?:/[^/]+)?$") -> DataFrame:
    """A column with the source in the name of each file, or of the folder that holds its parts."""
    return df.withColumn(column, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def first_column(df: DataFrame, candidates: list[str], required: bool = True) -> str | None:
    """The first of several column names that is there."""
    for c in candidates:
        if c in df.columns:
            return c
    if required:
        raise ValueError(f"none of {candidates} in {df.columns}")
    return None


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``word`` (lower case) and ``score`` from a CSV or TSV file with one of the usual column names; rows without a
    number are skipped. Of a word given several times the last row counts (of a file read as one split)."""
    df = read_any(spark, path)
    word, score = first_column(df, ["Word", "word", "lemma", "Lemma"]), first_column(df, ["Conc.M", "concreteness", "score", "Score"])
    rows = df.select(F.lower(F.trim(F.col(f"`{word}`"))).alias("word"), F.col(f"`{score}`").try_cast("double").alias("score"), F.monotonically_increasing_id().alias("at"))
    return rows.where("score is not null and word <> ''").groupBy("word").agg(F.max_by("score", "at").alias("score"))


def flat_for_csv(df: DataFrame) -> DataFrame:
    """Lists, structs and maps as JSON text."""
    return df.withColumns({f.name: F.to_json(F.col(f"`{f.name}`")) for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))})


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    """Parquet, CSV or JSON lines; ``by`` lays the table out in folders that later filters can skip."""
    writer = (flat_for_csv(df) if kind == "csv" else df).write.mode("overwrite")
    writer = writer.partitionBy(*by) if by else writer
    writer.option("header", True).option("escape", "\"").csv(path) if kind == "csv" else writer.format(kind).save(path)


def nested_json(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A JSON document per key with the list of its different records, in order."""
    lists = df.groupBy(key).agg(F.array_sort(F.collect_set(F.struct(*fields))).alias("records"))
    return lists.select(key, F.to_json(F.struct(key, "records")).alias("document"))


def write_graphml(edges: DataFrame, source: str, target: str, path: str, attributes: list[str]) -> None:
    """A directed graph file of an aggregated edge table (at most ``MAX_GRAPH`` edges, checked)."""
    rows = edges.select(source, target, *attributes).limit(MAX_GRAPH + 1).collect()
    if len(rows) > MAX_GRAPH:
        raise ValueError(f"more than {MAX_GRAPH} edges; write the table instead")
    nodes = sorted({str(x) for r in rows for x in (r[0], r[1])})
    with open(path, "w", encoding="utf-8") as out:
        out.write('<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n')
        for a in attributes:
            out.write(f'<key id={quoteattr(a)} for="edge" attr.name={quoteattr(a)} attr.type="string"/>\n')
        out.write('<graph edgedefault="directed">\n')
        out.writelines(f"<node id={quoteattr(n)}/>\n" for n in nodes)
        for r in rows:
            out.write(f"<edge source={quoteattr(str(r[0]))} target={quoteattr(str(r[1]))}>")
            out.writelines(f"<data key={quoteattr(a)}>{_escape(r[a])}</data>" for a in attributes)
            out.write("</edge>\n")
        out.write("</graph>\n</graphml>\n")


def _escape(x: object) -> str:
    return "" if x is None else str(x).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def markdown_table(df: DataFrame, title: str, rows: int = 8) -> str:
    """The first rows of a small report as a markdown note."""
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    body = ["| " + " | ".join("" if x is None else str(x) for x in r) + " |" for r in df.limit(rows).collect()]
    return "\n".join([f"# {title}", "", head, *body, ""])


def schema_summary(df: DataFrame) -> DataFrame:
    """``column``, ``kind``, ``n_rows``, ``n_nulls`` of every column, in one pass."""
    counts = [F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(f"`{c}`").isNull()).alias("n_nulls")) for c, k in df.dtypes]
    return df.agg(F.array(*counts).alias("x")).select(F.inline("x"))


def has_text(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"\S")
