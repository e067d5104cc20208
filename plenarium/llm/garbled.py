"""Text that went through a wrong decoding (problem 10).

Method: the characters of a text are mapped back to the bytes of a legacy code page; an automaton over byte classes
(one regular expression per code page, built from the code page and the structure of UTF-8) finds maximal spans of
well-formed multibyte sequences; those spans alone are decoded. Text garbled more than once is decoded again.

The automaton cannot see text of one single-byte code page read as another, since no multibyte sequence comes out of
it, nor letters that became question marks. Such characters are found by the corpus itself: a character between its
neighbours (a *context*) is mistaken if, mapped back to its byte and read by another code page, it gives a context that
is ``RATIO`` times as frequent in the corpus; a question mark, if letters between the same neighbours are. Replacement
characters and C1 controls mark text that cannot be restored, as question marks do.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenarium.lineage import cut, shared_folder

#: Code pages whose text may hold UTF-8 read byte by byte.
CODECS = ("cp1252", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "cp866")
#: (read as, written in) pairs of single-byte code pages.
PAIRS = (("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "iso8859-2"), ("cp1252", "cp1250"), ("cp1252", "cp1251"), ("cp1252", "koi8-u"), ("cp437", "cp1250"), ("mac_roman", "cp1250"), ("cp866", "cp1251"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"))

#: How much more frequent a context has to be than the one it is mistaken for (which counts as seen once at least).
RATIO = 50
#: Stands for a pair of code pages where a letter became a question mark.
LOST = "?"

# Decoded characters that prove a span by themselves: accented Latin letters, usual signs and punctuation.
_COMMON = regex.compile("[ -ſƒȘ-țˆ˜Ḁ-ỹ‐-⁄€№™•−≤≥]")
# Decoded characters of other scripts, believed in runs.
_OTHER = regex.compile(r"[\p{Cyrillic}\p{Greek}\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Arabic}\p{Hebrew}\p{So}\p{Sm}\p{M}\p{Cf}\p{Sk}]")
_UKRAINIAN = "іІґҐёЁєЄїЇўЎ"


def _bytes(codec: str) -> dict[int, str]:
    """Bytes from 0x80 on and the characters a decoder in ``codec`` makes of them (C1 controls where it has none)."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[b] = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


@lru_cache(maxsize=None)
def _automaton(codec: str) -> tuple[regex.Pattern, dict[str, int], frozenset[str], frozenset[str]]:
    """The pattern of well-formed spans, the byte of each character, and the characters that begin and go on a span."""
    table = _bytes(codec)
    back = {c: b for b, c in table.items()}
    if codec == "cp1252":  # Latin-1 shows the C1 controls themselves
        back |= {chr(b): b for b in range(0x80, 0xA0)}

    def some(*spans: tuple[int, int]) -> str:
        return "[" + "".join(regex.escape(c, literal_spaces=True) for c, b in back.items() if any(x <= b <= y for x, y in spans)) + "]"

    tail = some((0x80, 0xBF))
    two = some((0xC2, 0xDF)) + tail
    three = f"(?:{some((0xE0, 0xE0))}{some((0xA0, 0xBF))}|{some((0xE1, 0xEC), (0xEE, 0xEF))}{tail}|{some((0xED, 0xED))}{some((0x80, 0x9F))}){tail}"
    four = f"(?:{some((0xF0, 0xF0))}{some((0x90, 0xBF))}|{some((0xF1, 0xF3))}{tail}|{some((0xF4, 0xF4))}{some((0x80, 0x8F))}){tail}{tail}"
    leads = frozenset(c for c, b in back.items() if b >= 0xC2)
    return regex.compile(f"(?:{two}|{three}|{four})+"), back, leads, frozenset(c for c, b in back.items() if b < 0xC0)


def _believed(codec: str, span: str, text: str) -> bool:
    """Whether ``text``, decoded from ``span``, is what somebody wrote, rather than chance."""
    common = sum(bool(_COMMON.match(c)) for c in text)
    other = sum(bool(_OTHER.match(c)) for c in text)
    if common + other < len(text):
        return False
    if codec in ("cp1251", "cp866"):  # their own letters are leads: one pair may be an ordinary beginning of a word
        if codec == "cp866" and not any(c in "╨╤" for c in span):
            return False
        return len(text) >= 2 or not (span[1] in _UKRAINIAN or not span[1].isalpha() and span[1] in " …’“”„«»–—№§°·•")
    if codec in ("mac_roman", "cp1250"):
        return other == 0 or len(text) >= 3
    if other:
        emoji = regex.search(r"\p{So}", text) and len(span) > 3
        return bool(emoji) or len(text) >= 2 or codec == "cp437" and span[0] in "╨╤"
    return True


_LOST = regex.compile("[�\u0080-\u0084\u0086-\u009f]")


def _decode(text: str) -> tuple[str, int]:
    """``text`` with its multibyte spans decoded, and the number of spans."""
    spans = 0
    for _ in range(4):
        best: tuple[int, str, int] = (0, text, 0)
        there = set(text)
        for codec in CODECS:
            pattern, back, leads, tails = _automaton(codec)
            if leads.isdisjoint(there) or tails.isdisjoint(there) or codec == "cp866" and "╨" not in there and "╤" not in there:
                continue
            count = [0, 0]

            def fix(m: regex.Match, codec: str = codec, back: dict = back, count: list = count) -> str:
                out = bytes(back[c] for c in m[0]).decode()
                if not _believed(codec, m[0], out):
                    return m[0]
                count[0] += len(m[0])
                count[1] += 1
                return out

            new = pattern.sub(fix, text)
            if count[0] > best[0]:
                best = (count[0], new, count[1])
        if not best[0]:
            break
        text, spans = best[1], spans + best[2]
    return text, spans


@lru_cache(maxsize=1)
def _single() -> dict[str, dict[str, str]]:
    """For each pair of code pages: the characters of the first and what the second makes of their bytes."""
    out = {}
    for read, written in PAIRS:
        shown, meant = _bytes(read), _bytes(written)
        out[f"{read} {written}"] = {shown[b]: meant[b] for b in shown if shown[b] != meant[b] and meant[b].isprintable() and shown[b].isprintable()}
    return out


#: Code points from that on are no characters of a code page.
_TOP = 0xFFFF


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: what stands for it in a context (ASCII letters, question marks and letters and signs of code pages
    themselves, digits 0, anything else a space), and, as bits, the code pages in which it begins or goes on a
    multibyte span."""
    plain, lead, tail = np.full(_TOP + 1, ord(" "), np.int64), np.zeros(_TOP + 1, np.int64), np.zeros(_TOP + 1, np.int64)
    for c in range(0x80):
        plain[c] = c if chr(c).isalpha() or chr(c) == "?" else ord("0") if chr(c).isdigit() else ord(" ")
    for table in _single().values():
        for pair in table.items():
            for c in pair:
                if 0xA0 < ord(c) < _TOP:
                    plain[ord(c)] = ord(c)
    for i, codec in enumerate(CODECS):
        _, _, leads, tails = _automaton(codec)
        for members, bits in ((leads, lead), (tails, tail)):
            for c in members:
                bits[min(ord(c), _TOP)] |= 1 << i
    return plain, lead, tail


@dataclass
class Scan:
    """What a scan of several texts found: contexts, each with its text and place, and texts that may hold spans."""

    keys: np.ndarray
    texts: np.ndarray
    places: np.ndarray
    spans: np.ndarray


def scan(texts: list[str]) -> Scan:
    """The contexts of texts: each character of the code pages, and each question mark before a letter, between its
    neighbours, as one number of three characters. All texts are scanned together as arrays of code points."""
    plain, lead, tail = _classes()
    codes = np.minimum(np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32), _TOP)
    starts = np.cumsum([1] + [len(t) + 1 for t in texts])
    c = plain[codes]
    before, after = c[:-2], c[2:]
    letter = (after > 64) & (after < 128)
    at = np.flatnonzero((c[1:-1] > 127) | (c[1:-1] == ord("?")) & letter & (before != ord("0")) & (before != ord("?"))) + 1
    owner = np.searchsorted(starts, at, "right") - 1
    span = np.flatnonzero(lead[codes[:-1]] & tail[codes[1:]])
    return Scan(c[at - 1] << 32 | c[at] << 16 | c[at + 1], owner, at - starts[owner], np.unique(np.searchsorted(starts, span, "right") - 1))


def _slices(texts: list[str], most: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """``texts`` in parts of about so many characters, with the place of the first."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > most:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def mistaken(texts: DataFrame, text: str) -> DataFrame:
    """``context`` and ``pair`` (read as, written in; or ``LOST``): the contexts of a corpus that are mistaken ones.

    One pass over the texts, one grouping of contexts (counted per batch first; their number follows the alphabets, not
    the corpus; written to the shared checkpoint folder), and a join of contexts with what they would be. Counts are
    documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, part in _slices(b.column(0).to_pylist()):
                found = scan(part)
                once = np.unique(np.stack([found.texts, found.keys]), axis=1)[1] if len(found.keys) else found.keys
                keys, n = np.unique(once, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["context", "n"])

    def readings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            context, pair, other, n = [], [], [], []
            for key, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = [chr(key >> 32), chr(key >> 16 & 0xFFFF), chr(key & 0xFFFF)]
                for name, table in _single().items():
                    if c[1] in table:
                        x, y, z = (ord(table.get(q, q)) for q in c)
                        context.append(key)
                        pair.append(name)
                        other.append(x << 32 | y << 16 | z)
                        n.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(context, pa.int64()), pa.array(pair, pa.string()), pa.array(other, pa.int64()), pa.array(n, pa.int64())], ["context", "pair", "other", "n"])

    counts = cut(texts.select(text).mapInArrow(count, "context long, n long").groupBy("context").agg(F.sum("n").alias("n")))
    read = counts.mapInArrow(readings, "context long, pair string, other long, n long")
    known = counts.select(F.col("context").alias("other"), F.col("n").alias("m"))
    plainer = read.join(known, "other").where(F.col("m") >= RATIO * F.col("n")).select("context", "pair")
    # question marks: all letters that stand between the same neighbours count
    middle = F.shiftright("context", 16).bitwiseAND(F.lit(0xFFFF))
    ends = F.col("context") - F.shiftleft(middle, 16)
    letters = counts.where(middle > 127).groupBy(ends.alias("ends")).agg(F.sum("n").alias("m"))
    marks = counts.where(middle == ord("?")).select("context", ends.alias("ends"), "n")
    return plainer.unionByName(marks.join(letters, "ends").where(F.col("m") >= RATIO * F.col("n")).select("context", F.lit(LOST).alias("pair")))


@lru_cache(maxsize=1)
def _known(folder: str) -> dict[int, list[str]]:
    """The mistaken contexts in the shared folder, with their pairs."""
    system, path = pyarrow.fs.FileSystem.from_uri(folder)
    pairs: dict[int, list[str]] = {}
    for f in system.get_file_info(pyarrow.fs.FileSelector(path)):
        if f.path.endswith(".parquet"):
            for r in pq.read_table(f.path, filesystem=system).to_pylist():
                pairs.setdefault(r["context"], []).append(r["pair"])
    return pairs


def _recode(text: str, pairs: dict[int, list[str]]) -> tuple[str, bool, bool]:
    """``text`` with mistaken characters rewritten by the pair of code pages that explains most of them; whether there
    are any; whether some cannot be."""
    if not pairs or not text:
        return text, False, False
    found = scan([text])
    hits = [(p, pairs[k]) for k, p in zip(found.keys.tolist(), found.places.tolist(), strict=True) if k in pairs]
    if not hits:
        return text, False, False
    votes = Counter(pair for _, names in hits for pair in names if pair != LOST)
    lost = any(LOST in names for _, names in hits)
    if not votes:
        return text, True, lost
    best = min(votes, key=lambda p: (-votes[p], p))
    table, letters = _single()[best], list(text)
    belongs = lambda c: c.isalpha() or c in table
    for at, names in hits:
        if best in names:  # and other characters beyond ASCII of the same word
            left = right = at
            while left > 0 and belongs(text[left - 1]):
                left -= 1
            while right + 1 < len(text) and belongs(text[right + 1]):
                right += 1
            letters[left : right + 1] = [table.get(c, c) for c in text[left : right + 1]]
    return "".join(letters), True, lost


def repair_text(text: str, pairs: dict[int, list[str]] | None = None) -> tuple[bool, str | None, bool]:
    """Whether ``text`` went through a wrong decoding; the text as it was, as far as it can be restored (null if nothing
    of it can be); whether no sign of loss is left. ``pairs`` are the mistaken contexts of the corpus."""
    new, spans = _decode(text)
    new, odd, lost = _recode(new, pairs or {})
    lost = lost or bool(_LOST.search(new))
    return bool(spans or odd or lost), new if new != text else None, not lost


def repair_encoding(df: DataFrame, key: str, column: str) -> DataFrame:
    """The garbled rows of ``df``: ``key``, ``restored`` (null where nothing can be restored) and ``whole``, whether
    no sign of loss is left in it.

    Two passes over the texts, whole ones of any length: for the contexts of the corpus (see ``mistaken``; those found
    go through the shared folder), and to repair. Texts are not shuffled; plain ASCII texts without a question mark end
    in the JVM. Null, empty and blank texts give no row, repeated rows a row each.
    """
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key), F.col(column).alias("text")).where((F.octet_length(column) != F.char_length(column)) | F.col(column).contains("?"))
    folder = f"{shared_folder(df.sparkSession)}/mistaken"
    mistaken(rows, "text").write.parquet(folder)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _known(folder)
        odd = np.array(sorted(pairs), np.int64)
        for b in batches:
            keep, text, whole = [], [], []
            texts = b.column(1).to_pylist()
            for first, part in _slices(texts):
                found = scan(part)
                hit = np.unique(np.concatenate([found.texts[np.isin(found.keys, odd)], found.spans]))
                asked = set(hit.tolist()) | {i for i, t in enumerate(part) if _LOST.search(t)}
                for i in sorted(asked):
                    garbled, new, clean = repair_text(part[i], pairs)
                    if garbled:
                        keep.append(first + i)
                        text.append(new)
                        whole.append(new is not None and clean)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(text, pa.string()), pa.array(whole, pa.bool_())], [key, "restored", "whole"])

    return rows.mapInArrow(work, f"`{key}` {kind}, restored string, whole boolean")
