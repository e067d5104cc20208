"""Schemas that drift between files (problem 7).

Method: similarity flooding. Each file's schema is a graph of its fields, their types, nested fields and name parts.
For every two files that follow each other the pairs of nodes form a second graph, over which match scores spread until
they settle. The scores select consistent correspondences among the fields that went and those that came (see
``SELECT``); of these alone, an exact check of the values of common records confirms renamings. Fields are then followed
through the files, cast to one type and united in one table.

The records stay in Spark throughout. Flooding is grouped by file pair: a group holds two schemas, no records.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenarium.lineage import cut

FILE = ["series", "task", "run_no"]
Schema = dict[str, list]
#: Flooding ends when no score moves by more than this, or after so many rounds.
SETTLED, ROUNDS = 1e-3, 50
#: A correspondence is selected if its settled score is at least this share of the best one of either of its fields
#: among fields that went and came.
SELECT = 0.5
KINDS = ["boolean", "list", "number", "object", "string"]
#: Share of common records with equal values that makes a renaming.
EQUAL = 2 / 3
#: Correspondences (a row of four names each) that go to every task as one table; more of them are joined by a shuffle.
MOST_BROADCAST = 500_000
#: Columns of the united table: fields become columns in the driver, so that their number has to be checked.
MOST_COLUMNS = 5_000


def json_kind(schema: Column) -> Column:
    """The JSON type of a value from its variant schema; null for a JSON null."""
    return (
        F.when(schema == "VOID", None)
        .when(schema.startswith("ARRAY"), "list")
        .when(schema.startswith("OBJECT"), "object")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema == "STRING", "string")
        .otherwise("number")
    )


def read_objects(lines: DataFrame, *more: str) -> DataFrame:
    """The readable lines: ``line_id``, ``series``, ``task``, ``run_no``, ``record_key`` and ``object``, a map from field
    to value (variant); ``more`` columns of ``lines`` go along.

    A line is readable if a JSON object stands in it, alone or with text around; others give no row. Lines delivered
    twice stay. Lines without series, task or run number belong to no file."""
    body = F.col("body")
    whole = body.startswith("{") & body.endswith("}")
    value = F.try_parse_json(F.when(whole, body).otherwise(F.regexp_extract(body, r"(?s)\{.*\}", 0)))
    objects = lines.where("series is not null and task is not null and run_no is not null and body is not null").select("line_id", *FILE, "record_key", *more, value.alias("value"))
    return objects.select("line_id", *FILE, "record_key", *more, F.expr("try_variant_get(value, '$', 'map<string, variant>')").alias("object")).where("object is not null")


def read_fields(lines: DataFrame) -> DataFrame:
    """A row per field of each readable line, with its value as a ``variant``."""
    return read_objects(lines).select("line_id", *FILE, "record_key", F.explode("object").alias("field", "variant"))


def plain_value(variant: Column) -> Column:
    """The text of a value in which equal values are equal (numbers in one form); null for null."""
    kind = json_kind(F.schema_of_variant(variant))
    number, text = F.try_variant_get(variant, "$", "double").cast("string"), F.to_json(variant)
    return F.when(kind == "number", F.coalesce(number, text)).when(kind.isNotNull(), text)


def schemas(fields: DataFrame) -> DataFrame:
    """A row per file and field: ``kind``, the type of most of its non-null values (null if it has none; the
    alphabetically first of equally frequent ones), and ``nested``, names of nested fields seen.

    Values are counted by type in a hash aggregate; only objects are told apart by their fields."""
    shape = F.schema_of_variant("variant")
    names = F.array_join(F.regexp_extract_all(shape, F.lit(r"[<,]\s*`?([^`:<>,\s]+)`?:"), 1), " ")
    typed = fields.select(*FILE, "field", json_kind(shape).alias("kind"), F.when(shape.startswith("OBJECT"), names).otherwise("").alias("nested"))
    counts = typed.groupBy(*FILE, "field", "nested").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])
    whole = counts.groupBy(*FILE, "field").agg(*[F.sum(k).alias(k) for k in KINDS], F.max("nested").alias("nested"))
    best = F.array_min(F.array(*[F.when(F.col(k) > 0, F.struct((-F.col(k)).alias("minus"), F.lit(k).alias("kind"))) for k in KINDS]))
    return whole.select(*FILE, "field", best["kind"].alias("kind"), "nested")


def _parts(name: str) -> set[str]:
    return set(re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower().split("_"))


@lru_cache(maxsize=100_000)
def _name_match(a: str, b: str) -> float:
    """Likeness of two names: shared parts, shared letters in triples."""
    x, y = _parts(a), _parts(b)
    t, u = ({f"##{s.lower()}#"[i : i + 3] for i in range(len(s) + 1)} for s in (a, b))
    return 0.5 * len(x & y) / len(x | y) + 0.5 * len(t & u) / len(t | u)


def flood(old: Schema, new: Schema) -> np.ndarray:
    """Settled match scores of the fields of two schemas (rows: old, columns: new), each with the lists ``field``, ``kind``
    and ``nested``.

    Nodes are the files, fields, types, nested names; edges lead from file to field ("has"), field to type ("is") and
    field to nested name ("holds"). A pair of edges of the same kind joins two pairs of nodes; each pair passes its
    score on to its neighbours in equal shares per kind, starts anew from the likeness of names, and all scores are
    brought to a maximum of 1 after every round."""
    kinds = [*KINDS, None]
    is_old = np.array([[k == q for q in kinds] for k in old["kind"]], float)
    is_new = np.array([[k == q for q in kinds] for k in new["kind"]], float)
    nest_old, nest_new = (sorted({n for x in s["nested"] for n in x.split()}) for s in (old, new))
    has_old = np.array([[n in x.split() for n in nest_old] for x in old["nested"]], float).reshape(len(old["field"]), len(nest_old))
    has_new = np.array([[n in x.split() for n in nest_new] for x in new["nested"]], float).reshape(len(new["field"]), len(nest_new))
    names = np.array([[_name_match(a, b) for b in new["field"]] for a in old["field"]])
    nested = np.array([[float(a == b) for b in nest_new] for a in nest_old]).reshape(len(nest_old), len(nest_new))
    field, kind, root, start_nested = names.copy(), np.eye(len(kinds)), 1.0, nested.copy()
    # a pair of types passes its score on to the fields of both files that have them, and so on
    back = 1 / np.maximum(np.outer(is_old.sum(0), is_new.sum(0)), 1)
    degree = 1 / np.outer(np.maximum(has_old.sum(0), 1), np.maximum(has_new.sum(0), 1))
    fan = 1 / np.outer(np.maximum(has_old.sum(1), 1), np.maximum(has_new.sum(1), 1))
    start_kind, to_kinds = np.eye(len(kinds)), is_old.T
    for _ in range(ROUNDS):
        # from the pair of files, from pairs of types, from pairs of nested names
        grown = names + field + root / field.size + is_old @ (kind * back) @ is_new.T
        grown_kind = start_kind + kind + to_kinds @ field @ is_new
        grown_root = 1.0 + root + field.sum()
        top = max(grown.max(), grown_kind.max())
        if nested.size:
            grown = grown + has_old @ (nested * degree) @ has_new.T
            grown_nested = start_nested + nested + has_old.T @ (field * fan) @ has_new
            top = max(grown.max(), grown_kind.max(), grown_nested.max())
            nested = grown_nested / top
        after = grown / grown.max()
        change = np.abs(after - field).max()
        field, kind, root = after, grown_kind / top, grown_root / max(top, grown_root)
        if change < SETTLED:
            break
    return field


def _selected(score: np.ndarray) -> np.ndarray:
    """The pairs whose score is near the best of their row or of their column."""
    near = (score >= SELECT * score.max(1, keepdims=True)) | (score >= SELECT * score.max(0, keepdims=True))
    return near & (score > 0)


def correspondences(schema: DataFrame) -> DataFrame:
    """For every file and the file with the next lower number present (``before``): the correspondences, by flooding,
    of fields that went and fields that came, with their settled ``score``.

    A row of the tasks is one pair of files of a series and task (two schemas as lists); pairs in which nothing went or
    nothing came end in the JVM. Rows are spread over the session's number of shuffle partitions, since they are small
    in bytes but not in work."""
    part = F.struct("field", "kind", "nested")
    files = schema.groupBy(*FILE).agg(F.array_sort(F.collect_list(part)).alias("new"))
    order = Window.partitionBy("series", "task").orderBy("run_no")
    pairs = files.withColumns({"before": F.lag("run_no").over(order), "old": F.lag("new").over(order)})
    names = {c: F.transform(c, lambda x: x["field"]) for c in ("old", "new")}
    moved = (F.size(F.array_except(names["old"], names["new"])) > 0) & (F.size(F.array_except(names["new"], names["old"])) > 0)
    parts = int(schema.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = pairs.where(F.col("before").isNotNull() & moved).select(*FILE, "before", "old", "new").repartition(parts, *FILE)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, olds, news, scores = [], [], [], []
            for i, (was, now) in enumerate(zip(b.column("old").to_pylist(), b.column("new").to_pylist(), strict=True)):
                old, new = ({c: [f[c] for f in fields] for c in ("field", "kind", "nested")} for fields in (was, now))
                gone = [k for k, f in enumerate(old["field"]) if f not in new["field"]]
                come = [k for k, f in enumerate(new["field"]) if f not in old["field"]]
                score = flood(old, new)[np.ix_(gone, come)]
                for x, y in zip(*np.nonzero(_selected(score)), strict=True):
                    owner.append(i)
                    olds.append(old["field"][gone[x]])
                    news.append(new["field"][come[y]])
                    scores.append(float(score[x, y]))
            keys = [b.column(c).take(pa.array(owner, pa.int64())) for c in (*FILE, "before")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(olds, pa.string()), pa.array(news, pa.string()), pa.array(scores, pa.float64())], [*FILE, "before", "field_old", "field_new", "score"])

    kind = dict(schema.dtypes)["run_no"]
    return asked.mapInArrow(work, f"series string, task string, run_no {kind}, before {kind}, field_old string, field_new string, score double")


def renamings(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` whose values are equal for at least two thirds of the records with a non-null value in both
    files.

    Each field takes part in one renaming of a file: pairs are taken by share of equal values, then by flooded score,
    then by name, as long as both fields are free. Only values of paired fields are compared."""
    asked = pairs.select("series", "task", F.col("before").alias("run_no"), F.col("field_old").alias("field")).unionByName(pairs.select(*FILE, F.col("field_new").alias("field")))
    by_file = asked.groupBy(*FILE).agg(F.collect_set("field").alias("asked"))
    if pairs.count() <= MOST_BROADCAST:
        by_file = F.broadcast(by_file)
    # lines of files without a pair are left out before they are parsed; of the others the asked fields are read
    objects = read_objects(lines.join(by_file, FILE), "asked")
    found = F.filter(F.transform("asked", lambda f: F.struct(f.alias("field"), plain_value(F.element_at("object", f)).alias("value"))), lambda x: x["value"].isNotNull())
    filled = objects.where("record_key is not null").select("line_id", *FILE, "record_key", F.inline(found))
    once = filled.groupBy(*FILE, "record_key", "field").agg(F.min_by("value", "line_id").alias("value"))
    old = once.select("series", "task", F.col("run_no").alias("before"), "record_key", F.col("field").alias("field_old"), F.col("value").alias("value_old"))
    new = once.select(*FILE, "record_key", F.col("field").alias("field_new"), F.col("value").alias("value_new"))
    both = pairs.join(old, ["series", "task", "before", "field_old"]).join(new, [*FILE, "record_key", "field_new"])
    share = F.avg((F.col("value_old") == F.col("value_new")).cast("double"))
    equal = both.groupBy(*FILE, "before", "field_old", "field_new", "score").agg(share.alias("share")).where(F.col("share") >= EQUAL)
    # per file, a fold over its few confirmed pairs from the best on
    pair = F.struct((-F.col("share")).alias("share"), (-F.col("score")).alias("score"), "field_old", "field_new")
    nothing = F.array().cast("array<struct<share: double, score: double, field_old: string, field_new: string>>")
    take = lambda kept, p: F.when(F.exists(kept, lambda k: (k["field_old"] == p["field_old"]) | (k["field_new"] == p["field_new"])), kept).otherwise(F.concat(kept, F.array(p)))
    best = equal.groupBy(*FILE, "before").agg(F.array_sort(F.collect_list(pair)).alias("pairs"))
    return best.select(*FILE, "before", F.explode(F.aggregate("pairs", nothing, take)).alias("p")).select(*FILE, "before", "p.field_old", "p.field_new")


def changes(schema: DataFrame, renamed: DataFrame) -> DataFrame:
    """All changes: ``series``, ``task``, ``run_no``, ``change_kind``, ``field_old``, ``field_new``."""
    order = Window.partitionBy("series", "task").orderBy("run_no")
    files = schema.select(*FILE).distinct().withColumn("before", F.lag("run_no").over(order)).where("before is not null")
    new = schema.join(files, FILE).select(*FILE, "before", "field", F.col("kind").alias("kind_new"), F.lit(1).alias("in_new"))
    old = schema.join(files.select("series", "task", F.col("run_no").alias("after"), F.col("before").alias("run_no")), FILE).select(
        "series", "task", F.col("after").alias("run_no"), F.col("run_no").alias("before"), "field", F.col("kind").alias("kind_old"), F.lit(1).alias("in_old")
    )
    both = new.join(old, [*FILE, "before", "field"], "full")
    kind = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("kind_old") != F.col("kind_new"), "type_changed")
    plain = both.withColumn("change_kind", kind).where("change_kind is not null")
    plain = plain.join(renamed.select(*FILE, F.col("field_old").alias("field"), F.lit("removed").alias("change_kind")), [*FILE, "field", "change_kind"], "left_anti")
    plain = plain.join(renamed.select(*FILE, F.col("field_new").alias("field"), F.lit("added").alias("change_kind")), [*FILE, "field", "change_kind"], "left_anti")
    empty = F.lit("")
    return plain.select(
        *FILE, "change_kind", F.when(F.col("change_kind") == "added", empty).otherwise(F.col("field")).alias("field_old"), F.when(F.col("change_kind") == "removed", empty).otherwise(F.col("field")).alias("field_new")
    ).unionByName(renamed.select(*FILE, F.lit("renamed").alias("change_kind"), "field_old", "field_new"))


def drift(lines: DataFrame) -> DataFrame:
    """All changes of fields between the files of each series and task (see ``changes``).

    A file is the lines of one run number; it is held against the file with the next lower number present. Types are
    compared where a field has non-null values in both files. An empty table and single files have no changes.

    Schemas and renamings (a row per field of a file, no records) are written to the shared checkpoint folder, so that
    lines are parsed twice only: for the schemas and for the values of candidates."""
    schema = cut(schemas(read_fields(lines)))
    return changes(schema, cut(renamings(lines, cut(correspondences(schema)))))


def field_names(schema: DataFrame, renamed: DataFrame) -> DataFrame:
    """``task``, ``field``, ``name``, ``kind``: the one name of all fields that renamings of a task connect, in any series
    (the name that most files use, the alphabetically first of equally frequent ones), and the type that most of these
    files give it. A row per field name of a task, no records."""
    files = schema.groupBy("task", "field").agg(F.count(F.lit(1)).alias("files")).withColumn("other", F.col("field"))
    edges = renamed.select("task", F.col("field_old").alias("field"), F.lit(0).cast("long").alias("files"), F.col("field_new").alias("other")).distinct()

    def connect(group: pd.DataFrame) -> pd.DataFrame:
        root: dict[str, str] = {f: f for f in group["field"]}
        count = group.groupby("field")["files"].max().to_dict()

        def find(f: str) -> str:
            while root[f] != f:
                root[f] = f = root[root[f]]
            return f

        for r in group.itertuples():
            x, y = find(r.field), find(r.other)
            if x != y:
                root[max((x, y), key=lambda f: (-count[f], f))] = min((x, y), key=lambda f: (-count[f], f))
        return pd.DataFrame([(group["task"].iloc[0], f, find(f)) for f in root], columns=["task", "field", "name"])

    names = files.unionByName(edges).groupBy("task").applyInPandas(connect, "task string, field string, name string")
    kinds = schema.join(names, ["task", "field"]).where("kind is not null").groupBy("name", "kind").agg(F.count(F.lit(1)).alias("n"))
    best = kinds.groupBy("name").agg(F.min(F.struct((-F.col("n")).alias("minus"), "kind")).alias("b")).select("name", F.col("b.kind").alias("kind"))
    return names.join(best, "name", "left").select("task", "field", "name", F.coalesce("kind", F.lit("string")).alias("kind"))


#: Spark types of the columns of the united table.
TYPES = {"string": "string", "number": "double", "boolean": "boolean", "list": "array<string>", "object": "map<string, string>"}


def unified(lines: DataFrame) -> DataFrame:
    """One consistent table of all readable lines: ``line_id``, ``series``, ``task``, ``run_no``, ``record_key``, a typed
    column for every field (see ``field_names``), and ``uncast``, the JSON text of values that are not of their column's
    type, by field (null if there is none). A text where a list is due is a list of one.

    Names that differ in case only, or clash with a key, get a number. Lines delivered twice stay, with their
    ``line_id``. Lines are not shuffled: names (at most ``MOST_COLUMNS``, checked) become expressions."""
    schema = cut(schemas(read_fields(lines)))
    renamed = cut(renamings(lines, cut(correspondences(schema))))
    known = field_names(schema, renamed).limit(20 * MOST_COLUMNS + 1).collect()
    sources: dict[tuple[str, str], list[tuple[str, str]]] = {}
    for r in sorted(known):
        sources.setdefault((r["name"], r["kind"]), []).append((r["task"], r["field"]))
    if len(sources) > MOST_COLUMNS or len(known) > 20 * MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} fields")
    used = {"line_id", *FILE, "record_key", "uncast"}
    columns, leftovers = [], []
    for (name, kind), fs in sorted(sources.items()):
        label, n = name, 1
        while label.lower() in used:
            n += 1
            label = f"{name}_{n}"
        used.add(label.lower())
        value = F.coalesce(*[F.when(F.col("task") == t, F.element_at("object", f)) for t, f in fs])
        typed = F.try_variant_get(value, "$", TYPES[kind])
        if kind == "list":
            typed = F.coalesce(typed, F.array(F.try_variant_get(value, "$", "string")))
            typed = F.when(value.isNotNull() & ~F.is_variant_null(value), typed)
        columns.append(typed.alias(label))
        leftovers.append(F.when(value.isNotNull() & ~F.is_variant_null(value) & typed.isNull(), F.struct(F.lit(label).alias("key"), F.to_json(value).alias("value"))))
    rest = F.filter(F.array(*leftovers), lambda x: x.isNotNull()) if leftovers else F.array().cast("array<struct<key: string, value: string>>")
    return read_objects(lines).select("line_id", *FILE, "record_key", *columns, F.when(F.size(rest) > 0, F.map_from_entries(rest)).alias("uncast"))
