"""Benchmark decontamination by the q-gram lemma.

Texts are lower-cased, stripped of ASCII punctuation, their white space made single spaces; all lengths are in characters.
An item of m characters occurs in a document if some stretch of it is within k edits of the item, k a tenth of m. Such a
stretch shares at least m + 1 - q - kq q-grams with the item, on diagonals that lie within k of each other; so shared q-grams
are counted in bands of diagonals that overlap by more than k, bands below the bound are dropped, and what is left is
verified by banded alignment. q is 8, or less for items for which the bound would be none: the lemma holds for every item.
Items too short for one edit (under ten characters) must be found as they are, between word borders.

The benchmark is taken in blocks of bounded size, each sent to the executors and held against all documents in one pass
without a shuffle; copies and hot sources need no care, as each document is judged by itself. The driver holds the
benchmark's texts, so its memory bounds the benchmark, not the documents.

Defined results. Null and empty documents match nothing; items that are null, empty or all punctuation are in no
document. Very long documents are searched whole, in pieces that overlap. Repeated items match under each of their ids;
repeated documents match each by itself. Of several occurrences of an item in a document the one with the fewest edits is
given, the first of equals.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import slices

_DROP = string.punctuation.encode()
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MOST = 8  # characters of the longest q-gram: a byte of each in a machine word


@dataclass(frozen=True)
class Settings:
    q: int = 8  # characters of a q-gram, at most
    edit_percent: int = 10  # of an item's characters
    block_bytes: int = 8 << 20  # of items sent to the executors at once
    chunk_chars: int = 1 << 20  # of documents searched at once
    held_pairs: int = 1 << 22  # of places and items counted at once


def normalise(text: str | None) -> str:
    return b" ".join((text or "").lower().encode().translate(None, _DROP).split()).decode()


def _codes(text: str) -> np.ndarray:
    """The characters as numbers."""
    return np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), "<u4")


def _words(codes: np.ndarray) -> np.ndarray:
    """At each place one byte of each of the eight characters from there on, as one number. Unlike characters may share a
    byte: that can only add candidates, which are verified."""
    data = np.zeros(len(codes) + _MOST, np.uint8)
    data[: len(codes)] = codes if codes.dtype == np.uint8 else codes ^ codes >> 8 ^ codes >> 16
    return np.ndarray((len(codes),), "<u8", data, strides=(1,))


class Grams:
    """The q-grams of items of one q, with the items (numbers) and the places in them."""

    def __init__(self, q: int, numbers: np.ndarray, texts: list[str]) -> None:
        self.q, self.mask = q, np.uint64((1 << 8 * q) - 1)
        found = [_words(_codes(t))[: len(t) + 1 - q] & self.mask for t in texts]
        codes = np.concatenate(found)
        owner = np.repeat(numbers, [len(g) for g in found]).astype(np.int64)
        offset = np.concatenate([np.arange(len(g)) for g in found]).astype(np.int64)
        self.numbers = np.sort(numbers)
        self.codes, which = np.unique(codes, return_inverse=True)
        self.n = int(self.numbers[-1]) + 1
        order = np.lexsort((offset, owner, which))
        self.posted = which[order] * self.n + owner[order]  # sorted by code, then item
        self.offset = offset[order]
        self.bits = np.uint64(64 - min(24, max(12, len(self.codes).bit_length() + 5)))
        self.seen = np.zeros(1 << int(64 - int(self.bits)), bool)
        self.seen[(self.codes * _MIX) >> self.bits] = True

    def places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words hold a known q-gram, and which."""
        own = words if self.q == _MOST else words & self.mask
        at = np.flatnonzero(self.seen[(own * _MIX) >> self.bits])
        which = np.searchsorted(self.codes, own[at]).clip(max=len(self.codes) - 1)
        good = self.codes[which] == own[at]
        return at[good], which[good]

    def hits(self, at: np.ndarray, which: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place, item, place in the item) of all hits, for so few items at once that about so many hits are held."""
        ends = np.searchsorted(self.posted, (which + 1) * self.n) - np.searchsorted(self.posted, which * self.n)
        parts = max(1, min(len(self.numbers), -(-int(ends.sum()) // most)))
        borders = [*self.numbers[:: -(-len(self.numbers) // parts)].tolist(), self.n]
        for low, high in zip(borders[:-1], borders[1:], strict=True):
            first = np.searchsorted(self.posted, which * self.n + low)
            times = np.searchsorted(self.posted, which * self.n + high) - first
            hit = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times - first, times)
            yield np.repeat(at, times), self.posted[hit] % self.n, self.offset[hit]


class Index:
    """Items (id, text) with their q-grams."""

    def __init__(self, items: list[tuple[int | None, str | None]], settings: Settings = Settings()) -> None:
        self.settings = settings
        self.items = [(i, t) for i, t in ((i, normalise(t)) for i, t in items) if t]
        self.item_codes = [_codes(t) for _, t in self.items]
        size = np.array([len(t) for _, t in self.items], np.int64)
        self.budget = size * settings.edit_percent // 100
        q = np.clip(size // (self.budget + 1), 1, min(settings.q, _MOST))
        self.needed = size + 1 - q - self.budget * q
        self.grams = []
        for value in np.unique(q).tolist():
            numbers = np.flatnonzero(q == value)
            self.grams.append(Grams(value, numbers, [self.items[n][1] for n in numbers]))

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, edits, place) of each occurrence that is verified, of normalised texts."""
        if not self.items:
            return
        room = max(len(t) for _, t in self.items) * 2
        chunk, size = [], 0
        for k, text in enumerate(texts):
            step = max(self.settings.chunk_chars, 2 * room)
            for at in range(0, max(len(text), 1), step):  # a very long text in pieces that overlap by the longest match
                chunk.append((k, at, text[at : at + step + room], at + step + room >= len(text)))
                size += len(chunk[-1][2])
                if size >= self.settings.chunk_chars:
                    yield from self._search(chunk)
                    chunk, size = [], 0
        if chunk:
            yield from self._search(chunk)

    def _search(self, chunk: list[tuple[int, int, str, bool]]) -> Iterator[tuple[int, int, int, int]]:
        data = _codes("\n".join([t for _, _, t, _ in chunk] + [""]))
        ends = np.cumsum([len(t) + 1 for _, _, t, _ in chunk])
        words = _words(data)
        for grams in self.grams:
            at, which = grams.places(words)
            if not len(at):
                continue
            for place, item, offset in grams.hits(at, which, self.settings.held_pairs):
                exact = self.budget[item] == 0
                yield from self._as_they_are(chunk, ends, place[exact], item[exact])
                place, item, offset = place[~exact], item[~exact], offset[~exact]
                # An item's diagonals start at most an item's length before its document, so bands of two texts are kept
                # apart by what is verified below, which never leaves a text.
                band = (place - offset + len(data)) // (self.budget[item] + 1)
                both, i, count = _counts(np.concatenate([band, band - 1]), np.concatenate([item, item]))
                enough = count >= self.needed[i]
                for b, k in zip(both[enough].tolist(), i[enough].tolist(), strict=True):
                    yield from self._verify(chunk, ends, data, b, k)

    def _as_they_are(self, chunk, ends, place: np.ndarray, item: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Items without an edit budget, between word borders: one search for each pair of text and item with a shared gram."""
        pairs = np.unique(np.searchsorted(ends, place, "right") * len(self.items) + item)
        for pair in pairs.tolist():
            n, k = divmod(pair, len(self.items))
            text, begin, found, last = chunk[n]
            front = " " if begin == 0 else ""  # the next or the last piece holds what begins or ends at a cut
            at = f"{front}{found}{' ' * last}".find(f" {self.items[k][1]} ")
            if at >= 0:
                yield text, k, 0, begin + at + 1 - len(front)

    def _verify(self, chunk, ends, data, band: int, k: int) -> Iterator[tuple[int, int, int, int]]:
        """Aligns item k with the documents around a band of two widths of diagonals."""
        pattern, budget = self.items[k][1], int(self.budget[k])
        low = band * (budget + 1) - len(data)
        high = low + 2 * (budget + 1) - 1  # the diagonals low to high
        first = int(np.searchsorted(ends, max(low, 0), "right"))
        stop = int(np.searchsorted(ends, min(high + len(pattern) + budget, len(data) - 1), "right"))
        for n in range(first, min(stop, len(chunk) - 1) + 1):
            text, begin, found, _ = chunk[n]
            start = int(ends[n]) - 1 - len(found)
            a, z = max(low - start, 0), min(high - start + len(pattern) + budget, len(found))
            if z - a < len(pattern) - budget:
                continue
            place = found.find(pattern, a, z)
            if place >= 0:
                yield text, k, 0, begin + place
                continue
            edits = banded_edits(self.item_codes[k], data[start : start + len(found)], low - start, high - start, budget)
            if edits is not None:
                yield text, k, edits, begin + a


def _counts(band: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (band, item), and how often each occurs."""
    low = band.min() if len(band) else 0
    key, count = np.unique((item << np.int64(36)) | (band - low), return_counts=True)
    return (key & ((1 << 36) - 1)) + low, key >> 36, count


def banded_edits(pattern: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> int | None:
    """The fewest edits that turn the pattern into a stretch of text, over alignments whose cells (i of the pattern, j of
    the text) keep low - budget <= j - i <= high + budget; None if they are over the budget."""
    low, high = low - budget, high + budget
    width = high - low + 1
    lanes = np.arange(width, dtype=np.int32)
    padded = np.zeros(len(pattern) + width + 2, np.int32) - 1  # text[j] for j from low on, -1 outside it
    a, z = max(low, 0), min(low + len(padded), len(text))
    if z > a:
        padded[a - low : z - low] = text[a:z]
    far = np.int32(len(pattern) + len(text) + 1)
    cost = np.where((lanes + low >= 0) & (lanes + low <= len(text)), np.int32(0), far)
    drop = np.full(width, far, np.int32)
    for i, c in enumerate(pattern.tolist(), 1):
        drop[:-1] = cost[1:]  # from (i - 1, j), one diagonal up
        best = cost + (padded[i - 1 : i - 1 + width] != c)  # from (i - 1, j - 1), the same diagonal
        np.minimum(best, drop + 1, out=best)
        best -= lanes  # from (i, j - 1), one diagonal down
        np.minimum.accumulate(best, out=best)
        best += lanes
        if low + i < 0:
            best[: -(low + i)] = far
        if low + i + width > len(text) + 1:
            best[max(len(text) + 1 - low - i, 0) :] = far
        cost = best
        if not i & 7 and cost.min() > budget:
            return None
    least = int(cost.min())
    return least if least <= budget else None


def blocks(benchmark: DataFrame, settings: Settings = Settings()) -> list[list[tuple[int | None, str | None]]]:
    """The items (item_id, text) in blocks of at most block_bytes, read one by one."""
    out, size = [[]], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        if size >= settings.block_bytes:
            out.append([])
            size = 0
        out[-1].append((row["item_id"], row["text"]))
        size += len(row["text"] or "") * 2
    return out


MATCH = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("edits", T.IntegerType()),
        T.StructField("place", T.LongType()),
    ]
)


def matches(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each document (doc_id, text) and item that occurs in it: the edits, and the place in the normalised text."""
    passes = []
    for items in blocks(benchmark, settings):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            index = Index(items, settings)
            for batch in slices(batches):
                ids, best = batch.column("doc_id").to_pylist(), {}
                for text, k, edits, place in index.search([normalise(t) for t in batch.column("text").to_pylist()]):
                    best[text, k] = min(best.get((text, k), (edits, place)), (edits, place))
                rows = [(ids[t], index.items[k][0], e, p) for (t, k), (e, p) in sorted(best.items())]
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=MATCH.names)

        passes.append(docs.select("doc_id", "text").mapInArrow(run, MATCH))
    out = passes[0]
    for one in passes[1:]:
        out = out.unionByName(one)
    return out


def _tester(items: list[tuple[int | None, str | None]], settings: Settings):
    @F.arrow_udf("boolean")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = Index(items, settings)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                hit = np.zeros(len(part), bool)
                for text, *_ in index.search([normalise(t) for t in part.to_pylist()]):
                    hit[text] = True
                yield pa.array(hit)

    return found


def contaminated(benchmark: DataFrame, settings: Settings = Settings()):
    """A function of a text column: whether any item occurs in it."""
    tests = [_tester(items, settings) for items in blocks(benchmark, settings)]

    def test(text: Column) -> Column:
        out = F.lit(False)
        for one in tests:
            out = out | one(text)
        return out

    return test
