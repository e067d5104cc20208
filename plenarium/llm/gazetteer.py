"""Freely typed names mapped to a reference list (problem 5).

Method: a trie of all reference entries and their alias spellings, searched with a Levenshtein automaton (with
transpositions) whose reach depends on the length of the entry. All entries within reach are returned with their
distances (``candidates``); the nearest identifier wins (``match_names``). The different names of a table are collected
by a grouping first, so that a name is searched once however many rows hold it.

A reference of any length: it lies in the shared checkpoint folder, and tasks search it block by block, a trie each.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenarium.lineage import shared_folder
from plenarium.llm.canonical import canonical_text

NONE = "NONE"
#: Entries of a block of the reference (a trie in a task), and names that are searched in one block after the other.
BLOCK, NAMES = 50_000, 20_000
# Letters whose plain form no accent rule gives.
PLAIN_LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "ə": "a", "ı": "i", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"})


@dataclass(frozen=True)
class Words:
    """What a corpus writes around names and how it shortens words. All lists are empty by default."""

    before: tuple[str, ...] = ()  # words before a name that do not belong to it
    after: tuple[str, ...] = ()  # words behind it
    short: dict[str, tuple[str, ...]] = field(default_factory=dict, hash=False)  # words with their short forms


# Such words in country names typed freely.
COUNTRY_WORDS = Words(
    before=("govt of", "government of", "the state of", "state of", "the", "of", "from", "in", "to", "near", "at"),
    after=("today", "sic", "country", "state", "now"),
    short={"republic": ("rep",), "federal": ("fed",), "federation": ("fed",), "democratic": ("dem",), "kingdom": ("kgdm",), "saint": ("st",), "south": ("s",), "north": ("n",), "great": ("gt", "g"), "united": ("utd", "u"), "new": ("n",), "saudi": ("s",), "islamic": ("isl",), "socialist": ("soc",), "people": ("peop",), "bosnia": ("b",)},
)
_SMALL = {"of", "the", "and", "i"}


def fold(text: str) -> str:
    """Lower case, without accents, words of letters and digits parted by one space."""
    text = unicodedata.normalize("NFD", text.casefold().translate(PLAIN_LETTERS))
    text = regex.sub(r"\p{M}+", "", text).translate(PLAIN_LETTERS)
    text = regex.sub(r"(?<=\p{L})['’](?=\p{L})", "", text)
    return " ".join(regex.findall(r"[\p{L}\p{N}]+", text))


def reach(length: int) -> int:
    """Edits allowed in an entry of so many letters."""
    return 0 if length < 4 else 1 if length < 8 else 2 if length < 14 else 3


def aliases(name: str, shortened: dict[str, tuple[str, ...]]) -> set[str]:
    """Spellings (folded, with spaces) that stand for a reference name beside itself: words shortened, parts around an
    "of" in the other order, initials of what stands before it, small words left out."""
    words = fold(name).split()
    found = {" ".join(words)}
    for i, w in enumerate(words):
        for short in shortened.get(w, ()):
            for spelling in list(found):
                parts = spelling.split()
                if len(parts) == len(words):
                    found.add(" ".join([*parts[:i], short, *parts[i + 1 :]]))
    for i, w in enumerate(words):
        if w == "of" and 0 < i < len(words) - 1:
            rest = words[i + 1 :]
            found.add(" ".join([*rest, *words[: i + 1]]))
            if rest[0] == "the" and len(rest) > 1:
                found.add(" ".join([*rest[1:], *words[: i + 1], "the"]))
                found.add(" ".join([*rest[1:], *words[: i + 1]]))
            initials = "".join(w[0] for w in words[:i] if w not in _SMALL)
            core = [w for w in rest if w != "the"]
            if len(initials) > 1 and core:
                found.add(" ".join([initials, *core]))
    return found | {" ".join(w for w in spelling.split() if w not in _SMALL) for spelling in found}


class Trie:
    """Reference spellings as nested dictionaries; every end holds its entries (identifier and name)."""

    def __init__(self, entries: Iterable[tuple[str, str]], given: Words = Words()) -> None:
        self.given = given
        self.names: set[str] = set()
        self.root: dict = {}
        self.codes: dict[str, str] = {}
        for identifier, name in entries:
            self.codes.setdefault(identifier.casefold(), identifier)
            self.names.add(name)
            for spelling in aliases(name, given.short):
                self._add(spelling.replace(" ", ""), (identifier, name))
            if regex.fullmatch(r"[\p{Lu}\p{Ll}]{2,4}", name) and name.upper()[1:] != name.lower()[1:] and sum(c.isupper() for c in name) > 1:
                self.codes.setdefault(fold(name), identifier)

    def _add(self, key: str, entry: tuple[str, str]) -> None:
        node = self.root
        for c in key:
            node = node.setdefault(c, {})
        node.setdefault("", set()).add(entry)

    def search(self, word: str) -> dict[tuple[str, str], tuple[int, int]]:
        """All entries (identifier and name) that ``word`` is within the ``reach`` of, each with its least distance and,
        negative, the letters of the spelling at that distance.

        The automaton's state is the row of distances between the path walked in the trie and the beginnings of
        ``word``; a state of which no cell is within ``limit`` is dead, and the subtree is left out."""
        found: dict[tuple[str, str], tuple[int, int]] = {}
        n = len(word)
        limit = reach(n + 3)
        # an edit is at most `limit` places off the diagonal, so only that band of the row is kept exact
        stack = [(self.root, "", list(range(n + 1)), None, 0)]
        while stack:
            node, last, row, before, depth = stack.pop()
            if "" in node and row[n] <= reach(max(n, depth)):
                for entry in node[""]:
                    found[entry] = min(found.get(entry, (limit + 1, 0)), (row[n], -depth))
            for c, child in node.items():
                if not c:
                    continue
                new = [depth + 1] + [limit + 1] * n
                low, high = max(1, depth + 1 - limit), min(n, depth + 1 + limit)
                least = new[0]
                for j in range(low, high + 1):
                    cost = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (word[j - 1] != c))
                    if before is not None and j > 1 and word[j - 1] == last and word[j - 2] == c:
                        cost = min(cost, before[j - 2] + 1)
                    new[j] = cost
                    least = min(least, cost)
                if least <= limit:
                    stack.append((child, c, new, row, depth + 1))
        return found

    def completions(self, word: str, most: int) -> dict[str, int]:
        """Identifiers of entries that begin with ``word`` and are at most ``most`` letters longer (names cut off)."""
        node = self.root
        for c in word:
            if c not in node:
                return {}
            node = node[c]
        found: dict[str, int] = {}
        level = [node]
        for extra in range(most + 1):
            for node in level:
                for identifier, _ in node.get("", ()):
                    found.setdefault(identifier, extra)
            level = [child for node in level for c, child in node.items() if c]
        return found


def readings(name: str, given: Words) -> list[str]:
    """The name itself and the name without what is written around it, as folded text, the plainest last."""
    name = regex.sub(r"(?<=\p{Ll})(?=\p{Lu}\p{Ll})", " ", name) if " " not in name and regex.search(r"\p{Ll}\p{Lu}\p{Ll}", name) else name
    bare = regex.sub(rf"[\[(](?:{'|'.join(map(regex.escape, given.after))})[\])]", " ", name, flags=regex.I) if given.after else name
    texts = [fold(name), fold(bare)]
    while True:
        text = texts[-1]
        cut = next((text[len(w) + 1 :] for w in given.before if text.startswith(w + " ")), None)
        if cut is None:
            cut = next((text[: -len(w) - 1] for w in given.after if text.endswith(" " + w)), None)
        if cut is None:
            return list(dict.fromkeys(t for t in texts if t))
        texts.append(cut)


def nearest(trie: Trie, name: str) -> tuple[int, int, int, str] | None:
    """What ``name`` stands for in a trie: the identifier is last in the tuple, and the least tuple of several tries is
    the nearest. None if nothing is within reach.

    A code stands for its entry. Else the entry at the least distance within reach counts, over all readings of the
    name; a name cut off counts by the letters it lacks. Two different identifiers equally near: the name that needs
    no completion wins, then the longer entry (more of its letters are there), then the lower identifier."""
    best: tuple[int, int, int, str] | None = None
    none = (99, 0, 0, "")
    for i, text in enumerate(readings(name, trie.given)):
        key = text.replace(" ", "")
        if len(key) <= 4 and key in trie.codes:
            return -1, i, 0, trie.codes[key]
        for (identifier, _), (distance, letters) in trie.search(key).items():
            best = min(best or none, (distance, 0, letters, identifier))
        if len(key) >= 4 and (best is None or best[0] > 0):
            for identifier, extra in trie.completions(key, 2 if len(key) < 6 else 3).items():
                best = min(best or none, (1 if extra < 3 else 2, 1, extra, identifier))
    return best


@lru_cache(maxsize=2)
def _trie(folder: str, file: str, given: Words) -> Trie:
    system, _ = pyarrow.fs.FileSystem.from_uri(folder)
    return Trie(((r["id"], r["entry"]) for r in pq.read_table(file, filesystem=system).to_pylist()), given)


def _blocks(folder: str) -> list[str]:
    system, path = pyarrow.fs.FileSystem.from_uri(folder)
    return sorted(f.path for f in system.get_file_info(pyarrow.fs.FileSelector(path)) if f.path.endswith(".parquet"))


def _write_reference(reference: DataFrame, identifier: str, entry: str) -> str:
    folder = f"{shared_folder(reference.sparkSession)}/reference"
    entries = reference.select(F.col(identifier).alias("id"), F.col(entry).alias("entry")).dropna().where("entry <> ''").distinct()
    entries.write.option("maxRecordsPerFile", BLOCK).parquet(folder)
    return folder


def _different_names(rows: DataFrame, name: str) -> DataFrame:
    """The different names, over a number of partitions of their own: they are few bytes but much work."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.where(F.col(name) != "").groupBy(F.col(name).alias("name")).count().select("name").repartition(parts)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
    """Names of several batches together, so that a trie is built once for many of them."""
    held: list[str] = []
    for b in batches:
        held += b.column(0).to_pylist()
        while len(held) >= NAMES:
            yield held[:NAMES]
            held = held[NAMES:]
    if held:
        yield held


def candidates(rows: DataFrame, name: str, reference: DataFrame, identifier: str, entry: str, given: Words = Words()) -> DataFrame:
    """For every different name that is no entry itself: all entries within reach, as ``name``, ``identifier``, ``entry``
    and ``distance`` (edits between the folded forms). Names without any have no row."""
    folder = _write_reference(reference, identifier, entry)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _blocks(folder)
        for names in _held(batches):
            forms = [canonical_text(x) for x in names]
            exact = {form for f in files for form in forms if form in _trie(folder, f, given).names}
            for f in files:
                out = [(x, *e, d) for x, form in zip(names, forms, strict=True) if form not in exact for e, (d, _) in _trie(folder, f, given).search(fold(form).replace(" ", "")).items()]
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int32()))], ["name", "identifier", "entry", "distance"])

    found = _different_names(rows, name).mapInArrow(work, "name string, identifier string, entry string, distance int")
    return found.groupBy("name", "identifier", "entry").agg(F.min("distance").alias("distance"))


def match_names(rows: DataFrame, key: str, name: str, reference: DataFrame, identifier: str, entry: str, result: str, given: Words = Words()) -> DataFrame:
    """``key``, ``name`` and ``result`` of the rows whose ``name``, in the consistent form, is no ``entry`` letter for
    letter.

    ``result`` is the reference identifier that the name stands for, or ``NONE``. Null and empty names give no row.
    Every row counts, repeated ones too. An empty reference gives ``NONE`` for all rows. ``given`` are words of the
    corpus around names and in short forms.

    Shuffles: one grouping of the names (partial first, so a name that holds a third of the rows is one row after the
    map side), and one join of rows to different names; adaptive execution splits a skewed side there."""
    folder = _write_reference(reference, identifier, entry)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _blocks(folder)
        for names in _held(batches):
            forms = [canonical_text(x) for x in names]
            # names that differ in case only are searched once, unless words run together
            keys = [f if regex.search(r"\p{Ll}\p{Lu}\p{Ll}", f) else f.casefold() for f in forms]
            best: dict[str, tuple[int, int, int, str]] = {}
            exact: set[str] = set()
            for f in files:
                trie = _trie(folder, f, given)
                exact.update(form for form in forms if form in trie.names)
                for k, form in dict(zip(keys, forms, strict=True)).items():
                    found = nearest(trie, form)
                    if found is not None:
                        best[k] = min(best.get(k, found), found)
            kept = [(x, best[k][3] if k in best else NONE) for x, k, form in zip(names, keys, forms, strict=True) if form not in exact]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in kept], pa.string()), pa.array([c for _, c in kept], pa.string())], ["name", "found"])

    rows = rows.select(F.col(key).alias("key"), F.col(name).alias("name")).where("name <> ''")
    entries = reference.select(F.col(entry).alias("name")).distinct()
    mapping = _different_names(rows, "name").join(entries, "name", "left_anti").mapInArrow(work, "name string, found string")
    return rows.join(mapping, "name").select(F.col("key").alias(key), F.col("name").alias(name), F.col("found").alias(result))
