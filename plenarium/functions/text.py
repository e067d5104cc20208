"""Text expressions: normal forms, windows, tokens, counts, excerpts."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from plenarium.functions import vocab

TOKEN = "[A-Za-z][A-Za-z'-]+"
_MARKS = r"[^\p{L}\p{N}\p{M}_\s]"


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normal(c: Column, compat: bool = False) -> Column:
    """Lower case without punctuation, spaces collapsed. ``compat`` deletes punctuation (and trims before that);
    otherwise it becomes a space, so that both sides of a join agree on ``Pays-Bas``."""
    if compat:
        return F.regexp_replace(F.regexp_replace(F.trim(F.lower(c)), _MARKS, ""), r"\s+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), _MARKS, " "), r"\s+", " "))


def context_window(before: Column, current: Column, after: Column) -> Column:
    """``before || current || after``; null where the current sentence is null."""
    return F.concat(or_empty(before), F.lit(" || "), current, F.lit(" || "), or_empty(after))


def three_sentences(before: Column, current: Column, after: Column) -> Column:
    """The three sentences parted by spaces, nulls as empty."""
    return F.concat(or_empty(before), F.lit(" "), or_empty(current), F.lit(" "), or_empty(after))


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("long")


def numbers(c: Column) -> Column:
    return count_matches(c, r"\b\d+([.,]\d+)?\b")


def years(c: Column) -> Column:
    return count_matches(c, r"\b(19|20)\d{2}\b")


def spaced_tokens(c: Column) -> Column:
    """Parts between single spaces, empty ones counted."""
    return F.size(F.split(c, " ")).cast("long")


def tokens(c: Column, stopwords: Iterable[str] = vocab.STOPWORDS) -> Column:
    """Lower-case words of Latin letters without the stopwords; an empty list for null."""
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)
    stop = list(stopwords)
    return F.filter(found, lambda t: ~t.isin(stop))


def compact(c: Column) -> Column:
    """Separators of windows and runs of white space as one space."""
    return F.trim(F.regexp_replace(F.replace(c, F.lit("||"), F.lit(" ")), r"\s+", " "))


def excerpt(c: Column, length: int = 360) -> Column:
    short = compact(c)
    return F.when(F.char_length(short) > length, F.concat(F.rtrim(F.substring(short, 1, length - 3)), F.lit("..."))).otherwise(short)


def bare_id(c: Column) -> Column:
    """An identifier's letters and digits."""
    return F.regexp_replace(c, "[^A-Za-z0-9]", "")


def lenient_date(c: Column) -> Column:
    """``yyyy-MM-dd`` as a date; null for anything else."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date"))


def snippet(before: Column, current: Column, after: Column, length: int = 300) -> Column:
    return F.concat(F.lit("prev: "), F.substring(or_empty(before), 1, length), F.lit(" | cur: "), F.substring(or_empty(current), 1, length), F.lit(" | next: "), F.substring(or_empty(after), 1, length))


def keyword_pattern(keywords: Iterable[str] = vocab.KEYWORDS) -> str:
    """Whole words or phrases, longest first."""
    import re

    return r"\b(" + "|".join(re.escape(k) for k in sorted(keywords, key=lambda k: (-len(k), k))) + r")\b"


def stem_pattern(stems: Iterable[str] = vocab.STEMS) -> str:
    return "|".join(stems)


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of the value of ``c``, evaluated once. Without that, Catalyst may put the expression behind a column into
    a lambda, where it is evaluated for every element."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def contains_any(c: Column, markers: Iterable[str]) -> Column:
    """Whether a (lower-case) text holds a marker; false for null."""
    markers = [m.lower() for m in markers]
    if not markers:
        return F.lit(False)
    known = F.array(*map(F.lit, markers))
    return F.coalesce(once(c, lambda t: F.exists(known, lambda m: F.contains(t, m))), F.lit(False))


def hits(c: Column, markers: Iterable[str]) -> Column:
    """How many different markers a (lower-case) text holds."""
    known = F.array(*map(F.lit, sorted({m.lower() for m in markers})))
    return once(c, lambda t: F.size(F.filter(known, lambda m: F.contains(t, m))))


def first_marker(c: Column, markers: Iterable[str]) -> Column:
    """The longest marker found (alphabetically first of equal length); empty if none."""
    ordered = sorted({m.lower() for m in markers}, key=lambda m: (-len(m), m))
    if not ordered:
        return F.lit("")
    known = F.array(*map(F.lit, ordered))
    return F.coalesce(once(c, lambda t: F.get(F.filter(known, lambda m: F.contains(t, m)), F.lit(0))), F.lit(""))


def ordered_class(c: Column, classes: dict[str, list[str]], default: str) -> Column:
    """The first class, in order, with a marker in a (lower-case) text."""
    out = None
    for name, markers in classes.items():
        test = contains_any(c, markers)
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.lit(default) if out is None else out.otherwise(default)


def class_marker(c: Column, classes: dict[str, list[str]]) -> Column:
    """The marker that decided ``ordered_class``; empty if none."""
    out = None
    for markers in classes.values():
        test, marker = contains_any(c, markers), first_marker(c, markers)
        out = F.when(test, marker) if out is None else out.when(test, marker)
    return F.lit("") if out is None else out.otherwise("")


def class_first(c: Column, classes: dict[str, list[str]], at_once: int = 24) -> Column:
    """The marker that decides ``ordered_class``, by one pass over the markers in the order of classes, some ``at_once``
    and only as far as the first that has one; empty if none."""
    ordered = list(dict.fromkeys(m for markers in classes.values() for m in sorted({m.lower() for m in markers}, key=lambda m: (-len(m), m))))
    if not ordered:
        return F.lit("")
    parts = [F.array(*map(F.lit, ordered[i : i + at_once])) for i in range(0, len(ordered), at_once)]
    return F.coalesce(once(c, lambda t: F.coalesce(*[F.get(F.filter(part, lambda m: F.contains(t, m)), F.lit(0)) for part in parts])), F.lit(""))


def class_of(marker: Column, classes: dict[str, list[str]], default: str) -> Column:
    """The class of a marker found by ``class_first``: the first that has it."""
    table: dict[str, str] = {}
    for name, markers in classes.items():
        for m in markers:
            table.setdefault(m.lower(), name)
    return lookup(marker, table, default) if table else F.lit(default)


def lookup(c: Column, table: dict[str, str], default: str) -> Column:
    """The value of a key in a small dictionary, else the default; the default for null.

    Two arrays, not a map: Catalyst turns a look-up in a literal map into a chain of comparisons, each of which would
    evaluate ``c`` again."""
    at = F.array_position(F.array(*map(F.lit, table)), c)
    return F.coalesce(F.get(F.array(*map(F.lit, table.values())), (at - 1).cast("int")), F.lit(default))



def exact_mean(c: Column, decimals: int = 4) -> Column:
    """The mean of numbers of so many decimals, summed as whole numbers: the same for any order of rows."""
    return F.avg(F.round(c * 10**decimals).cast("long")) / 10**decimals
