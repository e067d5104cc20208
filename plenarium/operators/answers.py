"""Answers of a language model as text: pulling out the JSON object, repairing it, checking it; evidence for prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenarium.functions import text as T
from plenarium.operators import profiles

# Words for confidence, with the numbers they stand for; other names of fields.
CONFIDENCE = {"very high": "0.95", "high": "0.85", "medium": "0.6", "moderate": "0.6", "low": "0.3", "very low": "0.1"}
OTHER_NAMES = {
    "confidence": ["confidence", "confidence_score", "conf"],
    "evidence_use": ["evidentiary_use", "evidenti_use", "evidence_use", "evidentiaryUse"],
    "frame": ["dominant_framing", "dominant_frame", "dominantFrame", "main_framing"],
    "relation": ["relationship_type", "relation_type", "relationshipType", "rel_type"],
}


def json_object(body: Column) -> Column:
    """The JSON object in an answer, without thoughts, fences and text around it, as a variant; null if there is none."""
    plain = F.regexp_replace(F.regexp_replace(body, r"(?s)<think>.*?</think>", ""), r"```(?:json)?", "")
    value = F.try_parse_json(F.regexp_extract(plain, r"(?s)\{.*\}", 0))
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def first_field(value: Column, names: list[str]) -> Column:
    """The first of several fields of an object that is there, as text."""
    return F.coalesce(*[F.try_variant_get(value, f"$.{n}", "string") for n in names])


def number_of(c: Column, words: dict[str, str] = CONFIDENCE) -> Column:
    """A number written as such or as a word."""
    word = T.lookup(F.lower(F.trim(c)), words, "")
    return F.coalesce(c.try_cast("double"), F.nullif(word, F.lit("")).try_cast("double"))


def repaired(lines: DataFrame, body: str, names: dict[str, list[str]] = OTHER_NAMES) -> DataFrame:
    """``line_id`` and the fields of ``names`` from each answer (null where absent), confidence as a number within 0 and
    1, and ``readable``."""
    found = lines.select("line_id", json_object(F.col(body)).alias("v"))
    cols = {f: first_field(F.col("v"), ns) for f, ns in names.items() if f != "confidence"}
    confidence = number_of(first_field(F.col("v"), names["confidence"]))
    inside = F.when(confidence.between(0, 1), confidence)
    return found.select("line_id", F.col("v").isNotNull().alias("readable"), *[c.alias(f) for f, c in cols.items()], inside.alias("confidence"))


def allowed(c: Column, values: list[str]) -> Column:
    """A label in normal form if it is one of ``values``, else null."""
    label = F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")
    return F.when(label.isin(values), label)


# The fields of the answers of each task: kind, whether it has to be there, and labels or a greatest length.
ANSWER_FIELDS = {
    "task2_extracted_events": {
        "event_name": ("text", True, 150),
        "location_or_route": ("text", False, 200),
        "affected_cohort": ("label", False, ["refugees", "asylum_seekers", "students", "economic_migrants", "high_skilled_workers", "general_migration", "unspecified"]),
        "evidentiary_use": ("label", True, ["restriction", "solidarity", "burden_sharing", "institutional_reform", "neutral_reporting", "other"]),
        "confidence": ("share", True, None),
    },
    "task5_direction_framing": {
        "dominant_framing": ("label", True, ["capacity_pressure", "legal_obligation", "security_issue", "demographic_need", "humanitarian_responsibility", "mixed"]),
        "secondary_framing": ("text", False, None),
        "confidence": ("share", True, None),
        "rationale": ("text", True, 500),
    },
    "task6_policy_convergence": {
        "relation_type": ("label", True, ["mutual_acknowledged_alignment", "unilateral_modeling", "silent_convergence", "competitive_rivalry", "ideological_friction_despite_similarity", "diffusion_chain", "mutual_complaint", "administrative_coordination", "no_significant_interaction"]),
        "shared_target_cohort": ("text", False, 100),
        "tension_present": ("truth", True, None),
        "tension_nature": ("text", False, 300),
        "rationale": ("text", True, 600),
        "confidence": ("share", True, None),
    },
}


def checked(lines: DataFrame, key: str, task: str, body: str, fields: dict[str, dict[str, tuple]] = ANSWER_FIELDS, names: dict[str, list[str]] = OTHER_NAMES) -> DataFrame:
    """``key``, ``task`` and ``faults`` of every answer, held against the fields of its task: a list of ``field: fault``
    (missing, unknown label, out of range, too long, no truth value), or ``no object``. Fields are found under their other
    names too; lines of tasks without fields are left out."""
    known = {n: ns for ns in names.values() for n in ns}
    found = lines.where(F.col(task).isin(list(fields))).select(F.col(key).alias("key"), F.col(task).alias("task"), json_object(F.col(body)).alias("v"))
    faults = None
    for name, mine in fields.items():
        tests = []
        for field, (kind, required, bound) in mine.items():
            text = first_field(F.col("v"), list(dict.fromkeys([field, *known.get(field, [])])))
            missing = text.isNull() | (F.trim(text) == "")
            if kind == "label":
                wrong = F.when(allowed(text, bound).isNull(), "unknown label")
            elif kind == "share":
                wrong = F.when(~F.coalesce(number_of(text).between(0, 1), F.lit(False)), "out of range")
            elif kind == "truth":
                wrong = F.when(~F.lower(text).isin("true", "false"), "no truth value")
            else:
                wrong = F.when(F.char_length(text) > bound, "too long") if bound else F.lit(None).cast("string")
            fault = F.when(missing, "missing" if required else None).otherwise(wrong)
            tests.append(F.concat(F.lit(f"{field}: "), fault))
        listed = F.filter(F.array(*tests), lambda x: x.isNotNull())
        faults = F.when(F.col("task") == name, listed) if faults is None else faults.when(F.col("task") == name, listed)
    return found.select(F.col("key").alias(key), F.col("task").alias(task), F.when(F.col("v").isNull(), F.array(F.lit("no object"))).otherwise(faults).alias("faults"))


def prompts(evidence: DataFrame, template: str, columns: list[str], name: str = "prompt") -> DataFrame:
    """A prompt per row: ``template`` with a ``%s`` for each of ``columns`` (nulls as empty text)."""
    return evidence.withColumn(name, F.format_string(template, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def prompt_evidence(df: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """Per group: up to ``n`` sampled snippets as one text, in the order of the sample."""
    chosen = profiles.sample_per_stratum(df.where(F.col("sentence_content_current").isNotNull()), [group], key, n)
    line = T.snippet(F.col("sentence_content_previous"), F.col("sentence_content_current"), F.col("sentence_content_next"))
    entry = F.struct(profiles.hashed_order(key).alias("o"), F.col(key).alias("k"), line.alias("t"))
    return chosen.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["t"]), "\n").alias("evidence"), F.count(F.lit(1)).alias("n_snippets"))
