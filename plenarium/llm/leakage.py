"""Evaluation passages inside a training corpus (problem 9).

Method: every task turns its share of the corpus into FM-indexes (shards of bounded size). A shard is the sequence of
its words, with one symbol for every word that no test item holds. Its suffixes are sorted, the last column is kept in a
wavelet matrix, and every window of ``window`` words of the test items is searched backwards through wavelet ranks,
all windows together. Occurrences are located by walking to sampled suffix positions, mapped to documents, and
overlapping ones are merged into removal spans.

Suffixes are sorted by doubling their sorted length until no two are equal, so the rounds follow the logarithm of the
longest repeated passage of a shard.

Test items of any number: they are written to the shared checkpoint folder, with the list of their different words. A
task builds the index of a shard once and searches it with the items block by block, as it reads them from there. No
item passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenarium.lineage import shared_folder

#: Words of a shard (one document longer than that is a shard of its own), and items of a block of test items.
SHARD, BLOCK = 400_000, 5_000
#: Every so many positions of the text keep their place for locating.
SAMPLE = 8


def words(text: Column) -> Column:
    """Unbroken runs of letters or digits, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def write_items(items: DataFrame, item: str, text: str, window: int, folder: str) -> None:
    """The items with at least ``window`` words in files of at most ``BLOCK`` items, and their different words."""
    known = items.select(F.col(item).alias("item"), words(F.col(text)).alias("words")).where(F.col("item").isNotNull() & (F.size("words") >= window))
    known.write.option("maxRecordsPerFile", BLOCK).parquet(f"{folder}/items")
    spark = items.sparkSession
    spark.read.schema(known.schema).parquet(f"{folder}/items").select(F.explode("words").alias("word")).distinct().write.parquet(f"{folder}/words")


def _files(folder: str) -> tuple[pyarrow.fs.FileSystem, list[str]]:
    system, path = pyarrow.fs.FileSystem.from_uri(folder)
    found = system.get_file_info(pyarrow.fs.FileSelector(path))
    return system, sorted(f.path for f in found if f.path.endswith(".parquet"))


@lru_cache(maxsize=1)
def read_words(folder: str) -> pa.Array:
    """The different words of all items; number i + 2 is the word at place i."""
    system, files = _files(f"{folder}/words")
    parts = [pq.read_table(f, filesystem=system).column("word") for f in files]
    return pa.chunked_array([c for p in parts for c in p.chunks], pa.string()).combine_chunks()


@lru_cache(maxsize=4)
def read_block(folder: str, file: str, window: int) -> Patterns | None:
    """The windows of the items of one file."""
    system, _ = pyarrow.fs.FileSystem.from_uri(folder)
    table = pq.read_table(file, filesystem=system).combine_chunks()
    return patterns(table.column("item").combine_chunks(), table.column("words").combine_chunks(), read_words(folder), window) if table.num_rows else None


@dataclass
class Patterns:
    """The windows of a block of test items, as numbers of the vocabulary."""

    windows: np.ndarray  # different windows, one a row
    item_rows: np.ndarray  # a row of `windows`, in order ...
    items: np.ndarray  # ... and the place of an item that has it
    item_ids: pa.Array


def patterns(ids: pa.Array, lists: pa.ListArray, vocabulary: pa.Array, window: int) -> Patterns:
    """The windows of items that have at least ``window`` words each, all of them in the vocabulary."""
    number = pc.index_in(lists.flatten(), value_set=vocabulary).to_numpy(zero_copy_only=False).astype(np.int32) + 2
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    many = size - window + 1
    owner = np.repeat(np.arange(len(size)), many)
    first = np.repeat(np.cumsum(size) - size - (np.cumsum(many) - many), many) + np.arange(many.sum())
    windows, at = np.unique(number[first[:, None] + np.arange(window)], axis=0, return_inverse=True)
    order = np.argsort(at.reshape(-1), kind="stable")
    return Patterns(windows, at.reshape(-1)[order], owner[order], ids)


class FMIndex:
    """Backward search and locating over one sequence of small numbers.

    0 ends the sequence and stands nowhere else; 1 stands for all words that are in no pattern, and between documents.
    """

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        n = self.n = len(text)
        rank, span = text.astype(np.int64), 1
        while True:  # sort by the first `span` symbols, doubling it; the end symbol makes all suffixes different
            key = rank * (n + symbols) + np.roll(rank, -span)
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            if rank[order[-1]] == n - 1:
                break
            span *= 2
        last = text[order - 1]  # the symbol before each suffix; the text is a circle
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        row = last
        for level in reversed(range(self.levels)):
            bit = (row >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(int(n - self.ones[-1][-1]))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        self.last = last
        sampled = order % SAMPLE == 0
        self.sampled, self.sample_rank = sampled, np.cumsum(sampled) - 1
        self.samples = order[sampled]

    def ranks(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each ``symbol`` stands before ``place`` in the last column."""
        start = np.zeros(len(symbol), np.int64)
        for i, level in enumerate(reversed(range(self.levels))):
            ones, bit = self.ones[i], (symbol >> level) & 1 == 1
            a, b = ones[start], ones[place]
            start, place = np.where(bit, self.zeros[i] + a, start - a), np.where(bit, self.zeros[i] + b, place - b)
        return place - start

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows that occur, with the interval of suffixes that begin with each."""
        live = np.arange(len(windows))
        low, high = self.counts[windows[:, -1]], self.counts[windows[:, -1] + 1]
        for column in reversed(range(windows.shape[1] - 1)):
            some = high > low
            live, low, high = live[some], low[some], high[some]
            symbol = windows[live, column].astype(np.int64)
            low, high = self.counts[symbol] + self.ranks(symbol, low), self.counts[symbol] + self.ranks(symbol, high)
        some = high > low
        return live[some], low[some], high[some]

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Where in the text the suffixes at ``places`` begin: walk back to a sampled one."""
        steps, place, live = np.zeros(len(places), np.int64), places.copy(), np.arange(len(places))
        while len(live := live[~self.sampled[place[live]]]):
            symbol = self.last[place[live]].astype(np.int64)
            place[live] = self.counts[symbol] + self.ranks(symbol, place[live])
            steps[live] += 1
        return (self.samples[self.sample_rank[place]] + steps) % self.n


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows (key, words) in shards of about ``SHARD`` words."""
    held, size = [], 0
    for b in batches:
        ends = b.column(1).offsets.to_numpy()
        first = 0
        while first < b.num_rows:
            stop = max(first + 1, int(np.searchsorted(ends, ends[first] + SHARD - size, "right")) - 1)
            stop = min(stop, b.num_rows)
            held.append(b.slice(first, stop - first))
            size += int(ends[stop] - ends[first])
            first = stop
            if size >= SHARD:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


@dataclass
class Shard:
    """Documents with the index of their words."""

    keys: pa.Array
    index: FMIndex | None  # None: too few words for any window
    owner: np.ndarray  # the document of each place of the indexed text ...
    inner: np.ndarray  # ... and the place in it


def index_of(shard: pa.Table, vocabulary: pa.Array, window: int) -> Shard:
    lists = shard.column(1).combine_chunks()
    keys = shard.column(0).combine_chunks()
    number = pc.fill_null(pc.add(pc.index_in(lists.flatten(), value_set=vocabulary), 2), 1).to_numpy(zero_copy_only=False).astype(np.int32)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    # one symbol 1 after each document; runs of it are of no use and are drawn together; a 0 ends all
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inner = np.arange(len(number)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    end = np.cumsum(sizes) if len(sizes) else np.zeros(0, np.int64)
    text = np.insert(number, end, 1)
    owner, inner = np.insert(owner, end, np.arange(len(sizes))), np.insert(inner, end, -1)
    keep = np.concatenate([[True], (text[1:] != 1) | (text[:-1] != 1)]) if len(text) else np.zeros(0, bool)
    text, owner, inner = np.append(text[keep], 0), owner[keep], inner[keep]
    return Shard(keys, FMIndex(text, len(vocabulary) + 2) if len(text) > window else None, owner, inner)


def find(shard: Shard, block: Patterns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document of the shard, place of the item, and first word of each occurrence of a window."""
    nothing = np.zeros(0, np.int64)
    hit, low, high = shard.index.search(block.windows) if shard.index else (nothing, nothing, nothing)
    if not len(hit):
        return nothing, nothing, nothing
    many = high - low
    which = np.repeat(hit, many)
    place = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at = shard.index.locate(place)
    # a window may belong to several items
    first, stop = np.searchsorted(block.item_rows, which, "left"), np.searchsorted(block.item_rows, which, "right")
    share = stop - first
    item = block.items[np.repeat(first, share) + np.arange(share.sum()) - np.repeat(np.cumsum(share) - share, share)]
    return np.repeat(shard.owner[at], share), item, np.repeat(shard.inner[at], share)


def leaked_passages(corpus: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str, window: int = 12) -> DataFrame:
    """Passages of at least ``window`` consecutive words that a document shares with a test item.

    Columns ``key``, ``item``, ``first_word``, ``n_words``: the span to remove, in words of the document (from 0);
    overlapping or touching windows of an item are one span. Case, punctuation and white space do not count. Null,
    empty and short texts on either side share nothing. Repeated documents and items give a row each.

    Narrow over the corpus: no shuffle, no join; every document is read and indexed once, whole, however many items there
    are. Items lie in the shared folder, where tasks read ``BLOCK`` of them at a time.
    """
    kinds = dict(corpus.dtypes)[key], dict(items.dtypes)[item]
    schema = f"`{key}` {kinds[0]}, `{item}` {kinds[1]}, first_word long, n_words long"
    folder = shared_folder(corpus.sparkSession)
    write_items(items, item, item_text, window, folder)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, vocabulary = _files(f"{folder}/items")[1], read_words(folder)
        for part in _shards(batches) if len(vocabulary) else ():
            shard = index_of(part, vocabulary, window)
            for block in filter(None, (read_block(folder, f, window) for f in files)):
                row, which, first = find(shard, block)
                order = np.lexsort((first, which, row))
                row, which, first = row[order], which[order], first[order]
                fresh = np.ones(len(row), bool)
                fresh[1:] = (row[1:] != row[:-1]) | (which[1:] != which[:-1]) | (first[1:] > first[:-1] + window)
                begin = np.flatnonzero(fresh)
                stop = np.append(begin[1:], len(row)) - 1 if len(begin) else begin
                yield pa.RecordBatch.from_arrays([shard.keys.take(pa.array(row[begin])), block.item_ids.take(pa.array(which[begin])), pa.array(first[begin], pa.int64()), pa.array(first[stop] + window - first[begin], pa.int64())], [key, item, "first_word", "n_words"])

    documents = corpus.select(F.col(key).alias("key"), words(F.col(text)).alias("words")).where("key is not null and words is not null")
    return documents.mapInArrow(work, schema)
