"""Token ids of whole corpora by a public byte-level BPE tokenizer (problem 8).

Method: speculate and verify. The tokens of a word are proposed by greedy longest match. Byte-pair encoding has
exactly one result in which every two neighbours are *compatible* (encoded together they stay the same two tokens), so
a proposal is right if all its neighbours are. The test runs for all pairs of a batch at once with NumPy; only words
with a failing pair are merged exactly. Every different word of a task is encoded once.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public tokenizers' files.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: how the tokenizer cuts text into words.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words remembered by a task before it forgets them and starts again.
REMEMBER = 400_000


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files, and its byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(0x100) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """The tokens of a byte-level BPE with, for every merged token, the two it is made of."""

    def __init__(self, path: str) -> None:
        model = json.load(open(path, encoding="utf-8"))["model"]
        letters = _byte_letters()
        ids = model["vocab"]
        self.ids: dict[bytes, int] = {bytes(letters[c] for c in t): i for t, i in ids.items() if all(c in letters for c in t)}
        self.longest = max(map(len, self.ids))
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        size = max(ids.values()) + 1
        #: the rank at which a token comes into being: -1 for single bytes
        self.rank = np.full(size, -1, np.int64)
        self.left = np.arange(size)
        self.right = np.arange(size)
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            token = ids[a + b]
            self.ranks[ids[a], ids[b]] = (rank, token)
            if self.rank[token] < 0:
                self.rank[token], self.left[token], self.right[token] = rank, ids[a], ids[b]
        pairs = np.array([(a << 20 | b, r) for (a, b), (r, _) in self.ranks.items()], np.int64)
        pairs = pairs[pairs[:, 0].argsort()]
        self.pair_keys, self.pair_ranks = pairs[:, 0], pairs[:, 1]

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of merging ``a`` with ``b``; a very high one where there is no such merge."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], np.iinfo(np.int64).max)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the tokens ``a`` and ``b``, side by side, stay what they are.

        The last merge of the two is undone step by step, along the seam between them: if at some moment of the
        merging the two parts at the seam would have merged before the merges that made their neighbours, the seam
        would not have lasted."""
        a, b = a.copy(), b.copy()
        good = np.ones(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        live = np.arange(len(a))
        while len(live):
            x, y, most = a[live], b[live], limit[live]
            broken = self.pair_rank(x, y) < most
            good[live[broken]] = False
            rx, ry = self.rank[x], self.rank[y]
            # undo the younger of the two merges; at equal rank (one token twice) the left one was merged first
            split_x = rx > ry
            done = broken | ((rx < 0) & (ry < 0))
            limit[live] = np.where(split_x, rx, ry + 1)
            a[live] = np.where(split_x, self.right[x], x)
            b[live] = np.where(split_x, y, self.left[y])
            live = live[~done]
        return good

    def greedy(self, word: bytes) -> list[int]:
        """Longest tokens from left to right."""
        out, at = [], 0
        while at < len(word):
            for end in range(min(len(word), at + self.longest), at, -1):
                token = self.ids.get(word[at:end])
                if token is not None:
                    out.append(token)
                    at = end
                    break
            else:
                raise ValueError("a byte is missing in the vocabulary")
        return out

    def merged(self, word: bytes) -> list[int]:
        """The exact merging of ``word``: the pair of lowest rank first, the leftmost of equals.

        Parts are a linked list and pairs a heap, so that the work grows with n log n, whatever the length of the word."""
        parts = [self.ids[bytes([b])] for b in word]
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        heap = [(found[0], i, pair) for i, pair in enumerate(zip(parts, parts[1:], strict=False)) if (found := self.ranks.get(pair))]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            right = after[i]
            if right < 0 or (parts[i], parts[right]) != pair:
                continue  # one of the two has been merged since
            parts[i], parts[right] = self.ranks[pair][1], -1
            after[i] = after[right]
            if after[i] >= 0:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] >= 0 and (found := self.ranks.get(new := (parts[left], parts[after[left]]))):
                    heapq.heappush(heap, (found[0], left, new))
        return [p for p in parts if p >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The tokens of each word: proposed, tested together, and merged exactly where the test fails."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        proposed = [[t] if (t := self.ids.get(w)) is not None else self.greedy(w) for w in raw]
        size = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(size.sum()))
        word_of = np.repeat(np.arange(len(proposed)), size)
        inside = np.flatnonzero(word_of[1:] == word_of[:-1])
        key, back = np.unique(flat[inside] << 20 | flat[inside + 1], return_inverse=True)
        good = self.compatible(key >> 20, key & 0xFFFFF)[back] if len(key) else np.ones(0, bool)
        for i in np.unique(word_of[inside[~good]]):
            proposed[i] = self.merged(raw[i])
        return proposed


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_corpus(df: DataFrame, key: str, text: str, path: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """``key`` and ``ids``, the token ids of the whole ``text``, without special tokens (their strings are ordinary text).

    Null and empty texts have an empty list. One row for every row of ``df``, repeated ones too. Narrow: no shuffle;
    each task reads the vocabulary file at ``path``.
    """
    kind = dict(df.dtypes)[key]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, find = vocabulary(path), regex.compile(WORDS).findall
        known: dict[str, np.ndarray] = {}
        for b in batches:
            texts = b.column(1).to_pylist()
            cut = [find(t) if t else [] for t in texts]
            new = [*{w for words in cut for w in words if w not in known}]
            if len(known) + len(new) > REMEMBER:
                known.clear()
                new = [*{w for words in cut for w in words}]
            known.update((w, np.array(t, np.int32)) for w, t in zip(new, vocab.encode_words(new), strict=True))
            sizes, flat = np.zeros(len(cut) + 1, np.int64), []
            for i, words in enumerate(cut):
                if words:
                    flat.append(np.concatenate([known[w] for w in words]))
                    sizes[i + 1] = len(flat[-1])
            ids = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], [key, "ids"])

    # the text is checked to be there before it is sent, so that a null text needs no case of its own in the tasks
    return df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(work, f"`{key}` {kind}, ids array<int>")
