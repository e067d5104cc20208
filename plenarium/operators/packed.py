"""Several values packed in one field (problem 1).

Method: delimiters are inferred per source (a field of a table). The items of rows that are lists by their syntax (JSON
or Python lists, bullets, lists of quotes) are sure; against them every candidate delimiter is scored by

* piece-count consistency: the share of sure items that it leaves in one piece, times the agreement of the numbers of
  pieces in the rows that it divides with the numbers of sure items in theirs, and
* piece-type regularity: the share of pieces, in rows that hold it, of the type (a pair ``a / b`` or a plain phrase)
  that most sure items of the source have.

A candidate with a high score divides the field whenever it occurs; one that is often part of items (the comma in names)
divides only where no other does; one that breaks the type of items (the slash in pairs) never does. Then rows are
split outside quotes, and exploded with position. All of it is built from expressions of the engine; only the scores, a
handful of numbers per field, come to the driver. A source without sure items cannot be scored that way: every candidate
but the slash divides it, the comma where no other does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Candidate delimiters, as regular expressions.
CANDIDATES = {"line": r"[\r\n]+", "tab": r"\t+", "bar": r"\|+", "semicolon": "[;；]", "dot": r"\s[·•▪‣●]\s", "slash": r"\s/\s", "comma": "[,，、]"}
QUOTES = r"""(?:"(?:[^"\\]|\\.|"")*"|“[^”]*”|„[^“”]*[“”]|«[^»]*»)"""
QUOTE = '["“„«]'
BULLET = r"^\s*(?:[·•▪‣●*–-]|\d{1,2}[.)])\s+"
SPACE = " \t\n\r\f\u000b\u00a0\u2003\u2009"
#: From this score a delimiter always divides; from the lower one where no other is there.
ALWAYS, ALONE = 0.85, 0.3
#: Numbers of pieces from this on count as one in the comparison of numbers. Rows that a candidate has to divide before
#: their numbers of pieces say anything.
MANY, ENOUGH = 12, 20
PAIR = r"^[^/]+\s/\s[^/]+$"


@dataclass
class Dialect:
    """The delimiters of a source."""

    always: list[str]
    alone: list[str]


def _listed(text: Column) -> Column:
    """Whether a text is in square brackets."""
    bare = F.btrim(text, F.lit(SPACE))
    return bare.startswith("[") & bare.endswith("]")


def _list_items(text: Column) -> Column:
    """The items of a JSON or Python list; null for text of another shape."""
    json = F.from_json(text, "array<string>")
    quoted = F.regexp_extract_all(text, F.lit(r"""(?:^\s*\[|,)\s*('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")(?=\s*(?:,|\]\s*$))"""), 1)
    python = F.transform(quoted, lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"""\\(['"\\])""", "$1"))
    return F.when(_listed(text), F.coalesce(F.when(text.rlike(r"""(?s)^\s*\[\s*("|\]\s*$)"""), json), F.when(F.size(python) > 0, python)))


def _split(text: Column, delimiter: str) -> Column:
    """Pieces of ``text`` between delimiters outside quotes; a quote counts where a piece begins and ends with it."""
    pattern = rf"(?s)(?:^|{delimiter})(\s*{QUOTES}\s*(?=$|{delimiter})|(?:(?!{delimiter}).)*)"
    begun = F.regexp_replace(text, rf"^(?:\s*{delimiter})+", "")  # what stands before the first delimiter is nothing
    return F.when(text.rlike(QUOTE), F.regexp_extract_all(begun, F.lit(pattern), 1)).otherwise(F.split(text, delimiter))


def _outside(text: Column) -> Column:
    """A text with a letter in place of each quote."""
    return F.when(text.rlike(QUOTE), F.regexp_replace(text, rf"(?s){QUOTES}", "q")).otherwise(text)


def _bare(item: Column) -> Column:
    """An item without bullet, space and the quotes around it, quotes inside it unescaped."""
    item = F.btrim(item, F.lit(SPACE))
    inner = F.substring(item, F.lit(2), F.length(item) - 2)
    quoted = F.substring(item, 1, 1).isin(list('"“„«')) & item.rlike(rf"(?s)^{QUOTES}$")
    return F.when(quoted, F.trim(F.when(item.startswith('"'), F.regexp_replace(inner, r'""|\\"', '"')).otherwise(inner))).otherwise(item)


def _bulleted(text: Column) -> Column:
    """Whether a text is a list of items that each follow a bullet; the bullets become line ends."""
    return text.rlike(r"^\s*[·•▪‣●]\s")


def _no_bullets(text: Column) -> Column:
    lines = F.regexp_replace(text, rf"(?m){BULLET}", "")
    numbered = text.contains("\n") & text.rlike(rf"(?m){BULLET}.*\n{BULLET}")
    return F.when(_bulleted(text), F.regexp_replace(F.regexp_replace(text, r"^\s*[·•▪‣●]\s+", ""), r"\s*[\s][·•▪‣●]\s+", "\n")).when(numbered, lines).otherwise(text)


def _sure(text: Column) -> Column:
    """The items of a text that is a list by its syntax (brackets, bullets, or nothing but two or more quotes parted by a
    sign); null for other texts."""
    bullets = F.transform(F.split(_no_bullets(text), r"\n"), F.trim)
    quotes = text.rlike(rf"(?s)^\s*{QUOTES}(?:\s*[,;|\n\t]\s*{QUOTES})+\s*$")
    return F.coalesce(_list_items(text), F.when(_bulleted(text), bullets), F.when(quotes, F.transform(F.regexp_extract_all(text, F.lit(QUOTES), 0), _bare)))


def _overlap(a: dict[int, int], b: dict[int, int]) -> float:
    """What two distributions of numbers have in common, from 0 to 1."""
    m, n = sum(a.values()), sum(b.values())
    return sum(min(a.get(k, 0) / m, b.get(k, 0) / n) for k in a) if m and n else 0.0


def infer_dialects(rows: DataFrame) -> dict[tuple[str, str], Dialect]:
    """The delimiters of each source (columns ``record_table``, ``field``, ``text``), by their scores over all rows: one
    pass, one grouping; the result has a fixed size per source (candidates × numbers of pieces up to ``MANY``)."""
    named = rows.where(F.btrim("text", F.lit(SPACE)) != "").select("record_table", "field", _sure(F.col("text")).alias("sure"), _outside(F.col("text")).alias("outside"))
    named = named.withColumn("pairs", F.size(F.filter("sure", lambda x: x.rlike(PAIR))))
    sure, pairs = F.col("sure"), F.col("pairs")

    def candidate(name: str, delimiter: str) -> Column:
        whole = F.size(F.filter(sure, lambda x: ~x.rlike(delimiter)))
        pieces = F.filter(F.split("outside", delimiter), lambda x: F.btrim(x, F.lit(SPACE)) != "")
        plain = F.filter(pieces, lambda x: F.btrim(x, F.lit(SPACE)) != "q")
        there = sure.isNull() & F.col("outside").rlike(f"(?s){delimiter}")
        of_list = F.struct(F.lit(name).alias("name"), F.lit(True).alias("sure"), F.size(sure).alias("n"), whole.alias("good"), F.size(sure).alias("all"), pairs.alias("pairs"))
        of_row = F.struct(F.lit(name).alias("name"), F.lit(False).alias("sure"), F.size(pieces).alias("n"), F.size(F.filter(plain, lambda x: x.rlike(r"\s/\s"))).alias("good"), F.size(plain).alias("all"), F.lit(0).alias("pairs"))
        return F.when(sure.isNotNull(), of_list).when(there, of_row)

    scored = (
        named.select("record_table", "field", F.explode(F.filter(F.array(*[candidate(*c) for c in CANDIDATES.items()]), lambda c: c.isNotNull())).alias("c"))
        .groupBy("record_table", "field", F.col("c.name").alias("name"), F.col("c.sure").alias("sure"), F.least(F.col("c.n"), F.lit(MANY)).alias("n"))
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("c.good").alias("good"), F.sum("c.all").alias("all"), F.sum("c.pairs").alias("pairs"))
        .collect()
    )
    found: dict[tuple[str, str], Dialect] = {}
    for source in {(r["record_table"], r["field"]) for r in scored}:
        dialect = found[source] = Dialect([], [])
        for name, delimiter in CANDIDATES.items():
            mine = [r for r in scored if (r["record_table"], r["field"], r["name"]) == (*source, name)]
            known, split = [r for r in mine if r["sure"] and r["all"]], [r for r in mine if not r["sure"] and r["n"] > 1]
            items, pieces = sum(r["all"] for r in known), sum(r["all"] for r in split)
            if items:
                whole = sum(r["good"] for r in known) / items
                lengths = {r["n"]: r["rows"] for r in known if r["n"] > 1}, {r["n"]: r["rows"] for r in split}
                alike = _overlap(*lengths) if min(sum(x.values()) for x in lengths) >= ENOUGH else 1.0
                regular = sum(r["good"] for r in split) / pieces if pieces and 2 * sum(r["pairs"] for r in known) >= items else 1.0
                score = whole * max(alike, 0.5) ** 0.25 * regular
            else:
                score = {"slash": 0.0, "comma": (ALWAYS + ALONE) / 2}.get(name, 1.0)
            if score >= ALWAYS and name != "comma":  # a comma that is never part of an item still gives way to others
                dialect.always.append(delimiter)
            elif score >= ALONE:
                dialect.alone.append(delimiter)
        dialect.always.sort()
        dialect.alone.sort()
    return found


def items_of(text: Column, dialect: Dialect) -> Column:
    """The items of one packed text, in order: trimmed, without the quotes around them, empty ones dropped."""
    plain = _no_bullets(text)
    outside = _outside(plain)
    pieces = F.array(plain)
    if dialect.alone:
        alone = "(?:" + "|".join(dialect.alone) + ")"
        pieces = F.when(outside.rlike(f"(?s){alone}"), _split(plain, alone)).otherwise(pieces)
    if dialect.always:
        always = "(?:" + "|".join(dialect.always) + ")"
        pieces = F.when(outside.rlike(f"(?s){always}"), _split(plain, always)).otherwise(pieces)
    return F.filter(F.transform(F.coalesce(_list_items(text), pieces), _bare), lambda x: x != "")


def unpack(rows: DataFrame, fields: list[str]) -> DataFrame:
    """``rows`` (columns ``record_table``, ``record_id``, ``field``, ``text``) as one row per item, with ``pos`` from 1.

    Null, empty and blank texts give no row, nor do empty items and fields not asked for; equal items stay. A text with
    one item gives one row. A field of several tables has a dialect in each. Narrow: no shuffle but that of the scores."""
    filled = rows.where((F.btrim("text", F.lit(SPACE)) != "") & F.col("field").isin(fields))
    items = None
    for (name, field), dialect in sorted(infer_dialects(filled.select("record_table", "field", "text")).items(), key=str):
        mine = F.col("record_table").eqNullSafe(F.lit(name)) & (F.col("field") == field)
        split = items_of(F.col("text"), dialect)
        items = F.when(mine, split) if items is None else items.when(mine, split)
    items = F.array().cast("array<string>") if items is None else items
    return filled.select("record_table", "record_id", "field", F.posexplode(items).alias("at", "item")).select("record_table", "record_id", "field", (F.col("at") + 1).alias("pos"), "item")
