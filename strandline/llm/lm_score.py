"""Language-model scores by online logistic mixing of hashed-context bit predictors, beside a unigram base.

Model. Each byte of the A-Z lower-cased text, and one end, is spelled in the bits of a static prefix code of the training
bytes (frequent bytes take few bits). Every bit is predicted by several predictors, each a table of counts addressed by a
hash of its context (3 or 5 preceding bytes, or the current word so far) and of the place in the code. A count pair is
kept as quantised log-odds with one of eight confidences. Confidences gate the weights on the log-odds: there is one for
each predictor and confidence. Multipliers on the predictors are then refined online through the whole text: block by
block, in blocks that grow with the place in the text, they follow the gradient of the coding cost. The sum of the costs
is the text's total bits.

Learning. Two passes over the training documents: byte and word counts, then context counts, of all of them. Every task
adds up the contexts it meets, sorted by hash, and sends them to be summed by part. Tables are sized by the contexts
found: two slots or more for each, however many they are (hashes have 31 bits). Scoring tasks map them from a file that the
workers of an executor share, a byte a slot. Gate weights are fitted on every bit of every training document: a slot's counts
tell how often each bit met it, and what the slot says once that bit is taken off. For each predictor and confidence the
weight is that of least cost over all those bits; as the predictors share much of what they know, a fixed part of it is
used. Nothing depends on how the rows lie in files.

Base. The sum over tokens of log10((c + 1) / (N + V + 1)). Counts of the most frequent words, a bounded number, go to the
scoring tasks; all other words are joined with their counts in a shuffle, by 64-bit hashes, so the sum is whole.

Defined results. A null text is the empty one: one token, the end. Very long texts are scored whole, in pieces of
bounded size that carry contexts and multipliers on. Repeated rows get equal scores. Without training documents all
counts are 0 and every bit costs one bit. An empty table gives an empty result.
"""

from __future__ import annotations

import fcntl
import heapq
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import settle, slices
from strandline.llm.words import WordHasher, Words, gather, plain

END = 256  # the symbol after a text's last byte
END_TOKEN = b""  # its token: no word is empty
LEAD = 24  # bytes before each part in a chunk, zeros before a text: at least the longest context
WORD = -1  # the predictor whose context is the current word so far, its last LEAD bytes
_PARTS = np.zeros(256, bool)  # bytes that part words, the lead among them
_PARTS[[0, 32, *range(9, 14)]] = True


@dataclass(frozen=True)
class Settings:
    contexts: tuple[int, ...] = (3, 5, WORD)  # bytes before, or the word so far
    head_words: int = 200_000  # words whose counts scoring tasks hold
    share: float = 0.5  # of the weight a predictor would have alone
    sample_docs: int = 0  # for comparison: gates are fitted jointly, on about so many training documents instead of all
    sample_bits: int = 2_000  # of each of them, evenly spread
    row: int = 128  # bits of the shortest block, the one between two refinements
    growth: int = 8  # a block is this part of what came before it, at least a row
    rate: float = 0.02
    chunk_bytes: int = 1 << 18  # of texts scored side by side, and of the pieces of longer ones
    count_bytes: int = 1 << 19  # of texts whose contexts are hashed at once
    joined_bytes: int = 1 << 22  # of texts whose contexts are counted at once
    held_counts: int = 1 << 23  # of contexts, which a task adds up before it sends them
    tally_bytes: int = 1 << 25  # of texts whose words a task adds up before it sends their counts
    probe_bits: int = 21  # of the table in which scoring tasks look words up


class Code:
    """A static prefix code of 257 symbols. Its bits lie flat: symbol s has those from first[s] to first[s + 1]."""

    def __init__(self, counts: np.ndarray) -> None:
        heap = [(int(c) + 1, i, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        parent, n = {}, len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            parent[a[2]], parent[b[2]] = (n, 0), (n, 1)
            heapq.heappush(heap, (a[0] + b[0], n, n))
            n += 1
        nodes, bits, first = [], [], [0]
        for symbol in range(len(counts)):
            path, at = [], symbol
            while at in parent:
                at, bit = parent[at]
                path.append((at, bit))
            path.reverse()
            nodes += [node for node, _ in path]
            bits += [bit for _, bit in path]
            first.append(len(nodes))
        # One more place, for filling: no bit at all.
        self.first = np.array(first, np.int32)
        self.length = np.diff(self.first)
        self.salt = np.append(_mix(_mix(np.array(nodes, np.uint32))), np.uint32(0))
        self.bit = np.append(np.array(bits, np.int8), np.int8(0))
        self.sign = np.append(np.array(bits, np.float32) * 2 - 1, np.float32(0))
        self.eighth = self.sign / np.float32(8)
        self.fill = len(nodes)


#: A stretch of a text: the LEAD bytes before it, its bytes, and whether the text ends with it.
Part = tuple[bytes, bytes, bool]


def parts_of(text: bytes, limit: int) -> Iterator[Part]:
    """A text in parts of at most so many bytes."""
    whole = bytes(LEAD) + text
    for at in range(0, max(len(text), 1), limit):
        end = min(at + limit, len(text))
        yield whole[at : at + LEAD], text[at:end], end == len(text)


def word_pieces(text: bytes, limit: int) -> list[bytes]:
    """A text in pieces that end between words, of about so many bytes unless one word is longer."""
    out, at = [], 0
    while len(text) - at > limit:
        gap = _GAP.search(text, at + limit)
        end = gap.start() if gap else len(text)
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


_GAP = re.compile(rb"[ \t-\r]")


class Chunk:
    """Parts of texts laid side by side: symbols, contexts of each place, and where the parts lie."""

    def __init__(self, parts: list[Part], settings: Settings) -> None:
        data = np.frombuffer(b"".join([before + body + b"\0" * ended for before, body, ended in parts] + [bytes(LEAD)]), np.uint8)
        size = np.array([len(body) + ended for _, body, ended in parts], np.int64)  # with the end symbol
        ended = np.array([e for _, _, e in parts], bool)
        self.start = np.concatenate([[0], np.cumsum(size + LEAD)[:-1]]) + LEAD
        self.stop = self.start + size
        self.symbol = data.astype(np.int32)
        self.symbol[self.stop[ended] - 1] = END
        self.coded = np.ones(len(data), bool)  # places that are symbols, not lead
        for j in range(LEAD):
            self.coded[self.start - LEAD + j] = False
            self.coded[len(data) - LEAD + j] = False
        with np.errstate(over="ignore"):
            self.contexts = [self._word(data) if n == WORD else self._order(data, n) for n in settings.contexts]

    @staticmethod
    def _order(data: np.ndarray, n: int) -> np.ndarray:
        """A hash of the n bytes before each place: the eight bytes before it as one number, of which the last n are kept."""
        before = np.ndarray((len(data) - 8,), "<u8", data, strides=(1,))
        out = np.zeros(len(data), np.uint32)
        out[8:] = ((before >> np.uint64(64 - 8 * n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        return out

    @staticmethod
    def _word(data: np.ndarray) -> np.ndarray:
        """A hash of the bytes from the current word's start to the place, by running sums modulo 2 ** 32."""
        up, down = _powers(len(data))
        place = np.arange(len(data))
        begin = np.maximum.accumulate(np.where(np.concatenate([[True], _PARTS.take(data)[:-1]]), place, 0))
        np.maximum(begin, place - LEAD, out=begin)
        sums = np.concatenate([np.zeros(1, np.uint32), np.cumsum(_BYTES.take(data) * up[: len(data)], dtype=np.uint32)])
        return _mix((sums[:-1] - sums[begin]) * down[begin])


_powers_kept: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2 ** 32, at least n of each; kept by the process."""
    if not _powers_kept or len(_powers_kept[0]) < n:
        base, size = 0x01000193, max(1 << 20, 2 * n)
        _powers_kept[:] = [np.cumprod(np.append(np.uint32(1), np.full(size, b, np.uint32)), dtype=np.uint32) for b in (base, pow(base, -1, 1 << 32))]
    return _powers_kept[0], _powers_kept[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    return (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)


_BYTES = _mix(np.arange(256, dtype=np.uint32) + np.uint32(7))


def _hashes(context: np.ndarray, times: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A hash of each bit's context, that of its byte, and its place in the code."""
    h = np.repeat(context, times)
    h ^= salt
    h *= np.uint32(0x9E3779B1)
    return h


def _slots(context: np.ndarray, times: np.ndarray, salt: np.ndarray, bits: int) -> np.ndarray:
    """The slot of each bit: the first bits of its hash."""
    h = _hashes(context, times, salt)
    h >>= np.uint32(32 - bits)
    return h.astype(np.int64)


def _groups(texts: Iterator, limit: int, length=len) -> Iterator[list]:
    """Texts, or parts of texts, in groups of about so many bytes."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += length(t) + LEAD + 1
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


# Learning


TALLY = T.StructType(
    [
        T.StructField("kind", T.IntegerType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("n", T.LongType()),
        T.StructField("hash", T.LongType()),
    ]
)


class Tally:
    """Counts of the words and symbols of texts."""

    def __init__(self) -> None:
        self.hasher = WordHasher()
        self.chunks: list[tuple[np.ndarray, ...]] = []
        self.size = self.texts = 0
        self.symbols = np.zeros(257, np.int64)

    def add(self, texts: list[bytes]) -> None:
        """Whole texts, each in pieces that end between words where it is long."""
        pieces = [p for t in texts for p in word_pieces(t, 1 << 20)]
        for group in _groups(iter(pieces), 1 << 20):
            self._add(group)
        self.texts += len(texts)
        self.symbols[END] += len(texts)

    def _add(self, texts: list[bytes]) -> None:
        words = self.hasher.split(texts)
        hashes, first, counts = np.unique(words.hashes, return_index=True, return_counts=True)
        starts = words.starts[first]
        self.chunks.append((words.data, hashes, starts + self.size, words.ends[first] - starts, counts))
        self.size += len(words.data)
        self.symbols[:256] += np.bincount(words.data, minlength=256)
        self.symbols[10] -= len(texts)  # the line ends that part texts

    def take(self) -> pa.RecordBatch:
        """Rows of the words added since the last time."""
        data, hashes, starts, sizes, counts = (np.concatenate(x) for x in zip(*self.chunks, strict=True))
        kinds, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        n = np.bincount(inverse, counts, len(first)).astype(np.int64)
        keys = pa.concat_arrays([gather(data, starts[first], sizes[first]), pa.array([END_TOKEN], pa.binary())])
        n, kinds = np.append(n, self.texts), np.append(kinds, np.uint64(0)).view(np.int64)
        self.chunks, self.size, self.texts = [], 0, 0
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), keys, pa.array(n), pa.array(kinds)], names=TALLY.names)


def tally(docs: DataFrame, settings: Settings) -> DataFrame:
    """Rows (kind, key, n, hash): kind 0 counts tokens, kind 1 symbols, of docs (text). hash is the word's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Tally()
        texts = (plain(t) for batch in slices(batches) for t in batch.column("text").to_pylist())
        for group in _groups(texts, 4 * settings.chunk_bytes):
            held.add(group)
            if held.size >= settings.tally_bytes:
                yield held.take()
        if held.chunks:
            yield held.take()
        found = {str(i).encode(): int(n) for i, n in enumerate(held.symbols) if n}
        columns = [pa.array([1] * len(found), pa.int32()), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([0] * len(found), pa.int64())], names=TALLY.names)

    sums = docs.select("text").mapInArrow(run, TALLY).groupBy("kind", "key")
    return sums.agg(F.sum("n").alias("n"), F.max("hash").alias("hash"))


class Head:
    """Logs of the most frequent words by hash: one probe a word. Words whose place is taken go to a next table, until all
    have a place; few words get that far."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, end: int, floor: int, bits: int) -> None:
        """hashes are 64-bit numbers, the most frequent words first; end is the count of the end."""
        self.end, self.seen_end = float(np.log10((end + 1) / floor)), int(end > 0)
        logs = np.log10((counts + 1.0) / floor)
        self.tables: list[tuple[np.uint64, np.ndarray, np.ndarray]] = []
        while len(hashes):
            own = min(bits, (8 * len(hashes)).bit_length())
            shift = np.uint64(64 - own)
            place = self._place(hashes, len(self.tables), shift)
            _, first = np.unique(place, return_index=True)
            keys, values = np.zeros(1 << own, np.uint64), np.zeros(1 << own)
            keys[place[first]], values[place[first]] = hashes[first], logs[first]
            self.tables.append((shift, keys, values))
            rest = np.ones(len(hashes), bool)
            rest[first] = False
            hashes, logs = hashes[rest], logs[rest]

    @staticmethod
    def _place(hashes: np.ndarray, step: int, shift: np.uint64) -> np.ndarray:
        """The place in the table of a step: other bits of the hash each time."""
        with np.errstate(over="ignore"):
            return ((hashes * np.uint64(2 * step + 1)) >> shift).astype(np.int64)

    def look_up(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """By text the sum of logs of known words and how many these are; the hashes of the other words, in order of texts, and
        how many each text has."""
        logs, left, hashes = np.zeros(len(words.hashes)), np.arange(len(words.hashes)), words.hashes
        for step, (shift, keys, values) in enumerate(self.tables):
            place = self._place(hashes, step, shift)
            hit = keys.take(place) == hashes
            logs[left[hit]] = values.take(place[hit])
            left, hashes = left[~hit], hashes[~hit]
        sums = np.concatenate([[0.0], np.cumsum(logs)])
        base = sums[words.borders[1:]] - sums[words.borders[:-1]]
        others = np.diff(np.searchsorted(left, words.borders))
        return base + self.end, np.diff(words.borders) - others + self.seen_end, hashes, others


COUNTS = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("slots", T.LongType()),
        T.StructField("data", T.BinaryType()),
    ]
)
TABLES = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("data", T.BinaryType())])
CODES = T.StructType([*TABLES.fields, T.StructField("seen", T.BinaryType())])


def _add_up(packed: list[np.ndarray], shift: int, block: int = 1 << 16) -> np.ndarray:
    """Numbers (key << shift | count), sorted, with the counts of equal keys added up. The list is emptied, and sums are made
    block by block in place: memory holds the numbers once."""
    x, at = np.empty(sum(map(len, packed)), np.uint64), 0
    while packed:
        some = packed.pop()
        x[at : at + len(some)] = some
        at += len(some)
    some = None
    x.sort()
    up, low, done = np.uint64(shift), np.uint64((1 << shift) - 1), 0
    for begin in range(0, len(x), block):
        counts = np.cumsum(x[begin : begin + block] & low, dtype=np.uint64)
        keys = x[begin : begin + block] >> up
        last = np.append(np.flatnonzero(keys[1:] != keys[:-1]), len(keys) - 1)
        sums = (keys[last] << up) + np.diff(counts[last], prepend=np.uint64(0))
        if done and x[done - 1] >> up == keys[0]:  # a key that the block before began
            x[done - 1] += sums[0] & low
            sums = sums[1:]
        x[done : done + len(sums)] = sums
        done += len(sums)
    x.resize(done, refcheck=False)
    return x


def _pack(packed: np.ndarray, shift: int, pack: zstandard.ZstdCompressor) -> bytes:
    """Sorted numbers (key << shift | count) in few bytes: steps between keys, then counts, byte by byte."""
    keys, counts = packed >> np.uint64(shift), packed & np.uint64((1 << shift) - 1)
    planes = np.concatenate([np.diff(keys, prepend=np.uint64(0)), counts]).view(np.uint8).reshape(2, -1, 8)
    return pack.compress(np.ascontiguousarray(planes.transpose(0, 2, 1)))


def _unpack(data: bytes, shift: int, unpack: zstandard.ZstdDecompressor) -> np.ndarray:
    planes = np.frombuffer(unpack.decompress(data), np.uint8).reshape(2, 8, -1)
    steps, counts = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.uint64)[..., 0]
    return (np.cumsum(steps, dtype=np.uint64) << np.uint64(shift)) | counts


def part_bits(n_symbols: int) -> int:
    """The parts of a predictor's counts, as a power of two: they grow in number with the input, not in size."""
    return max(0, n_symbols.bit_length() - 23)


def bit_keys(parts: list[Part], code: Code, settings: Settings) -> Iterator[np.ndarray]:
    """By predictor the keys of the parts' bits: 31 bits of the hash of context and place, then the bit itself."""
    chunk = Chunk(parts, settings)
    times = np.where(chunk.coded, code.length[chunk.symbol], 0)
    at = _places(chunk.symbol, times, code)
    salt, bit = code.salt.take(at), code.bit.take(at).astype(np.uint32)
    for context in chunk.contexts:
        h = _hashes(context, times, salt)
        h &= np.uint32(0xFFFFFFFE)
        h |= bit
        yield h


def bit_counts(context: np.ndarray, symbol: np.ndarray, code: Code) -> np.ndarray:
    """Numbers (key << 32 | count), in order, of one predictor's keys as bit_keys() has them. Texts repeat themselves, so equal
    pairs of context and symbol are counted first, and only unlike ones are spelled in bits."""
    pairs = context.astype(np.uint64) << np.uint64(9)
    pairs |= symbol.astype(np.uint64)
    pairs.sort()
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    n, pairs = np.diff(first, append=len(pairs)).astype(np.uint64), pairs[first]
    symbol = (pairs & np.uint64(511)).astype(np.int32)
    times = code.length[symbol]
    at = _places(symbol, times, code)
    h = _hashes((pairs >> np.uint64(9)).astype(np.uint32), times, code.salt.take(at))
    h &= np.uint32(0xFFFFFFFE)
    h |= code.bit.take(at).astype(np.uint32)
    return _add_up([h.astype(np.uint64) << np.uint64(32) | np.repeat(n, times)], 32)


def count_contexts(docs: DataFrame, code: Code, parts: int, settings: Settings) -> DataFrame:
    """Rows (part, slots, data): the counts of all contexts of docs (text). Of each predictor there are 2 ** parts parts, by the first bits of the key; slots is how many contexts and places one has."""
    kinds = len(settings.contexts)
    own = np.uint64(64 - parts)  # bits of a packed number below those that name its part
    shift = 32 + parts  # in a part, keys are short and counts may be large

    def flush(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for k in range(kinds):
            if not held[k]:
                continue
            sums = _add_up(held[k], 32)
            ends = np.searchsorted(sums, np.arange(1, 1 << parts, dtype=np.uint64) << own) if parts else []
            rows = [(k << parts | j, 0, _pack(x, 32, pack)) for j, x in enumerate(np.split(sums, ends)) if len(x)]
            for at in range(0, len(rows), 32):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 32], strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=COUNTS.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(kinds)]
        kept = [0] * kinds  # numbers left by the last adding up
        places: list[list[np.ndarray]] = [[] for _ in range(kinds + 1)]  # contexts by predictor, then symbols

        def spell() -> None:
            """Counts the places and adds them to what is held."""
            symbol = np.concatenate(places[kinds])
            for k in range(kinds):
                context = np.concatenate(places[k])
                places[k].clear()
                held[k].append(bit_counts(context, symbol, code))
                if sum(map(len, held[k])) > kept[k] + settings.held_counts // 4:
                    held[k] = [_add_up(held[k], 32)]
                    kept[k] = len(held[k][0])
            places[kinds].clear()

        for batch in slices(batches):
            stretches = (p for t in batch.column("text").to_pylist() for p in parts_of(plain(t), settings.count_bytes))
            for group in _groups(stretches, settings.count_bytes, lambda p: len(p[1])):
                chunk = Chunk(group, settings)
                coded = np.flatnonzero(chunk.coded)
                for own, x in zip(places, [*chunk.contexts, chunk.symbol.astype(np.int16)], strict=True):
                    own.append(x.take(coded))
                if sum(map(len, places[kinds])) >= settings.joined_bytes:
                    spell()
                    if sum(kept) > settings.held_counts:
                        yield from flush(held)
                        kept[:] = [0] * kinds
        if places[kinds]:
            spell()
        yield from flush(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        part, found, kept = -1, [], 0

        def row() -> pa.RecordBatch:
            sums = _add_up(found, shift)
            slots = sums >> np.uint64(shift + 1)
            n = 1 + int(np.count_nonzero(slots[1:] != slots[:-1]))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n]), pa.array([_pack(sums, shift, pack)], pa.binary())], names=COUNTS.names)

        for batch in batches:
            for p, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if p != part and found:
                    yield row()
                    found, kept = [], 0
                part, x = p, _unpack(data, 32, unpack)
                x, n = x >> np.uint64(32), x & np.uint64(0xFFFFFFFF)
                found.append(((x & np.uint64((1 << 32 - parts) - 1)) << np.uint64(shift)) | n)
                if sum(map(len, found)) > 2 * kept + (1 << 20):
                    found = [_add_up(found, shift)]
                    kept = len(found[0])
        if found:
            yield row()

    n_parts = kinds << parts
    sent = docs.select("text").mapInArrow(run, COUNTS)
    return sent.repartition(max(min(n_parts, 64), n_parts // 32), "part").sortWithinPartitions("part").mapInArrow(add, COUNTS)


def quantised(counts: DataFrame, parts: int, bits: list[int]) -> DataFrame:
    """Rows (part, data, seen): the codes of all slots of a part, where predictor k has 2 ** bits[k] slots, and left_out()."""
    shift = 32 + parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
                x = _unpack(data, shift, unpack)
                keys, n = x >> np.uint64(shift), x & np.uint64((1 << shift) - 1)
                at = (keys >> np.uint64(32 - bits[part >> parts])).astype(np.int64)
                pairs = _pairs(keys, n, at, 1 << bits[part >> parts] - parts)
                data, seen = pack.compress(codes(pairs)), left_out(pairs).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([data], pa.binary()), pa.array([seen], pa.binary())], names=CODES.names)

    return counts.select("part", "data").mapInArrow(run, CODES)


def table_bits(slots: int, parts: int) -> int:
    """The size of a table, as a power of two, for so many contexts and places: two slots or more for each, whatever their
    number, up to the 31 bits of the hash."""
    return min(31, max(10, parts, (2 * slots - 1).bit_length() if slots else 0))


def _pairs(keys: np.ndarray, n: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Counts of zeros and of ones by slot."""
    out = np.zeros((2, size))
    for bit in (0, 1):
        one = (keys & np.uint64(1)) == bit
        out[bit] = np.bincount(at[one], n[one], size)
    return out


def counts_at(counts: DataFrame, parts: int, bits: list[int], wanted: list[np.ndarray]) -> list[np.ndarray]:
    """By predictor the count pairs of the wanted slots (sorted, distinct; as many as the gate sample has at most)."""
    shift, spark = 32 + parts, counts.sparkSession
    shared = spark.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
                k, j = part >> parts, part & (1 << parts) - 1
                size = 1 << bits[k] - parts
                own = shared.value[k]
                own = own[np.searchsorted(own, j * size) : np.searchsorted(own, (j + 1) * size)] - j * size
                x = _unpack(data, shift, unpack)
                keys, n = x >> np.uint64(shift), x & np.uint64((1 << shift) - 1)
                found = _pairs(keys, n, (keys >> np.uint64(32 - bits[k])).astype(np.int64), size)[:, own]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([found.tobytes()], pa.binary())], names=TABLES.names)

    out = [np.zeros((2, len(w))) for w in wanted]
    for row in counts.select("part", "data").mapInArrow(run, TABLES).toLocalIterator():
        k, j = row["part"] >> parts, row["part"] & (1 << parts) - 1
        first, stop = np.searchsorted(wanted[k], [j << bits[k] - parts, (j + 1) << bits[k] - parts])
        out[k][:, first:stop] = np.frombuffer(row["data"]).reshape(2, -1)
    return out


#: The least totals of the confidences above none.
_TOTALS = np.array([1, 2, 3, 6, 16, 61, 401])
#: The log-odds that the lower five bits of a code stand for: finer near nothing.
_STEPS = np.arange(-16, 16)
ODDS = (np.sign(_STEPS) * 8 * (np.abs(_STEPS) / 15) ** 1.4).clip(-8, 8).astype(np.float32)
EMPTY = 16  # the code of a slot without counts


def codes(pairs: np.ndarray) -> np.ndarray:
    """Count pairs in a byte each: five bits of log-odds of a one, three of confidence."""
    out = np.full(pairs.shape[1], EMPTY, np.uint8)
    some = np.flatnonzero(pairs[0] + pairs[1])
    zeros, ones = pairs[:, some].astype(np.float32)
    odds = np.log(ones + np.float32(0.4)) - np.log(zeros + np.float32(0.4))
    step = np.rint(np.sign(odds) * 15 * (np.abs(odds).clip(max=8) / 8) ** np.float32(1 / 1.4)).astype(np.uint8) + np.uint8(16)
    out[some] = np.searchsorted(_TOTALS, zeros + ones, "right").astype(np.uint8) << 5 | step
    return out


def left_out(pairs: np.ndarray, few: int = 64) -> np.ndarray:
    """By bit and code, how many of the bits counted in pairs find that code in their slot once they are taken off it themselves."""
    zeros, ones = pairs[:, np.flatnonzero(pairs[0] + pairs[1])].astype(np.int64)
    small = (zeros < few) & (ones < few)  # most of them: equal pairs are taken at once
    times = np.bincount(zeros[small] * few + ones[small], minlength=few * few)
    kinds = np.flatnonzero(times)
    pairs = np.concatenate([np.stack([kinds // few, kinds % few]), np.stack([zeros[~small], ones[~small]])], axis=1)
    times = np.append(times[kinds], np.ones(len(pairs[0]) - len(kinds), np.int64))
    out = np.zeros((2, 256))
    for bit in (0, 1):
        some = pairs[bit] > 0
        less = pairs[:, some].astype(float)
        less[bit] -= 1
        out[bit] = np.bincount(codes(less), (times * pairs[bit])[some], 256)
    return out


def _places(symbol: np.ndarray, times: np.ndarray, code: Code) -> np.ndarray:
    """The place in the code of each bit: the run of its symbol's places, repeated times beyond its length as filling."""
    ends = np.cumsum(times)
    first = (code.first[symbol] - (ends - times)).astype(np.int32)
    at = np.repeat(first, times)
    at += np.arange(len(at), dtype=np.int32)
    return at


# Scoring


def vote_of(weights: np.ndarray) -> np.ndarray:
    """What the codes of a predictor stand for: log-odds of a one, weighted by confidence, in steps of an eighth."""
    every = np.arange(256)
    return np.rint(np.clip(weights[every >> 5] * ODDS[every & 31] * 8, -127, 127)).astype(np.int8)


class State:
    """How far a text has come: its multipliers, the gradient and the rows since the last refinement, bits that fill no row yet."""

    def __init__(self, kinds: int) -> None:
        self.factor, self.change = np.ones(kinds, np.float32), np.zeros(kinds, np.float32)
        self.rows, self.left = 0, [np.zeros(0, np.float32)] * kinds


class Mixer:
    def __init__(self, code: Code, tables: list[np.ndarray], settings: Settings) -> None:
        """tables hold votes, a power of two of them each."""
        self.code, self.tables, self.settings = code, tables, settings
        self.bits = [len(t).bit_length() - 1 for t in tables]
        self.starts = np.zeros(1, np.int64)

    def votes(self, parts: list[Part], fill: bool) -> tuple[list[np.ndarray], np.ndarray]:
        """By predictor the votes for the bits that came, of all parts, and how many bits each part has. With fill, every part is
        filled up to whole rows."""
        code, chunk = self.code, Chunk(parts, self.settings)
        times = np.where(chunk.coded, code.length[chunk.symbol], 0)
        sums = np.concatenate([[0], np.cumsum(times)])
        length = sums[chunk.stop] - sums[chunk.start]
        filling = -length % self.settings.row if fill else length * 0
        times[chunk.stop - 1] += filling
        at = _places(chunk.symbol, times, code)
        stop = np.cumsum(length + filling)
        at[np.repeat(stop - np.cumsum(filling), filling) + np.arange(int(filling.sum()))] = code.fill
        at = at.astype(np.intp)
        salt, sign = code.salt.take(at), code.eighth.take(at)
        return [t.take(_slots(c, times, salt, b), mode="wrap") * sign for t, c, b in zip(self.tables, chunk.contexts, self.bits, strict=True)], length

    def _step_of(self, row: np.ndarray) -> np.ndarray:
        """The block that a row belongs to."""
        top = int(row.max()) + 1 if len(row) else 0
        if self.starts[-1] < top:
            starts = self.starts.tolist()
            while starts[-1] < top:
                starts.append(starts[-1] + max(1, starts[-1] // self.settings.growth))
            self.starts = np.array(starts, np.int64)
        return np.searchsorted(self.starts, row, "right") - 1

    def nats(self, texts: list[bytes]) -> np.ndarray:
        """The coding cost of each text; texts go side by side, multipliers are each text's own."""
        size = self.settings.row
        votes, length = self.votes([next(parts_of(t, max(len(t), 1))) for t in texts], True)
        rows = -(-length // size)
        filling = rows * size - length  # has no votes and costs a bit each
        first = np.concatenate([[0], np.cumsum(rows)[:-1]])
        row = np.arange(int(rows.sum())) - np.repeat(first, rows)
        lane = np.repeat(np.arange(len(texts)), rows)
        factor, change = (np.full((len(votes), len(texts)), x, np.float32) for x in (1, 0))
        cost = self._refine([v.reshape(-1, size) for v in votes], row, lane, factor, change)
        return np.add.reduceat(cost, first) - filling * np.log(2)

    def long_nats(self, text: bytes) -> float:
        """The same of one text of any length, piece by piece."""
        size, kinds, total = self.settings.row, len(self.tables), 0.0
        state = State(kinds)
        for part in parts_of(text, self.settings.chunk_bytes):
            votes, _ = self.votes([part], False)
            flat = [np.concatenate([a, b]) for a, b in zip(state.left, votes, strict=True)]
            filling = -len(flat[0]) % size if part[2] else 0
            keep = (len(flat[0]) + filling) // size * size
            flat = [np.concatenate([f, np.zeros(filling, np.float32)]) for f in flat]
            state.left = [f[keep:] for f in flat]
            rows = state.rows + np.arange(keep // size)
            factor, change = state.factor[:, None].copy(), state.change[:, None].copy()
            cost = self._refine([f[:keep].reshape(-1, size) for f in flat], rows, np.zeros(len(rows), np.int64), factor, change)
            state.factor, state.change, state.rows = factor[:, 0], change[:, 0], state.rows + len(rows)
            total += float(cost.sum()) - filling * np.log(2)
        return total

    def _refine(self, votes: list[np.ndarray], row: np.ndarray, lane: np.ndarray, factor: np.ndarray, change: np.ndarray) -> np.ndarray:
        """The cost of each row. Lanes go side by side; in each, multipliers follow the gradient once a block is whole."""
        s, step = self.settings, self._step_of(row)
        cost = np.zeros(len(row))
        order = np.argsort(step, kind="stable")
        kinds = step[order]
        borders = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]])) if len(order) else np.zeros(0, int)
        for rows in np.split(order, borders[1:]) if len(order) else []:
            now = int(step[rows[0]])
            whole = self._whole(now, row, lane, rows)
            own = factor[:, lane[rows]]
            part = [v[rows] for v in votes]
            z = part[0] * own[0][:, None]
            for v, m in zip(part[1:], own[1:], strict=True):
                z += v * m[:, None]
            e = np.exp(-z)
            wrong = e + 1
            cost[rows] = np.log(wrong).sum(axis=1)
            np.divide(e, wrong, out=wrong)
            for k, v in enumerate(part):
                change[k] += np.bincount(lane[rows], np.einsum("ij,ij->i", wrong, v), change.shape[1])
            share = s.rate / np.sqrt(self.starts[now + 1] - self.starts[now])
            factor[:, whole] = np.clip(factor[:, whole] + np.float32(share) * change[:, whole], 0.25, 3)
            change[:, whole] = 0
        return cost

    def _whole(self, step: int, row: np.ndarray, lane: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The lanes in which a block ends with these rows."""
        if step + 1 == len(self.starts):
            self._step_of(np.array([self.starts[-1]]))
        return lane[rows[row[rows] + 1 == self.starts[step + 1]]]

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 of the probability of each plain text."""
        out, limit = np.zeros(len(texts)), self.settings.chunk_bytes
        long = [i for i, t in enumerate(texts) if len(t) > limit]
        for i in long:
            out[i] = self.long_nats(texts[i])
        for group in _groups((i for i, t in enumerate(texts) if len(t) <= limit), limit, lambda i: len(texts[i])):
            out[group] = self.nats([texts[i] for i in group])
        return -out / np.log(10)


GATE = T.StructType(
    [
        T.StructField("hash", T.LongType()),
        T.StructField("bit", T.BinaryType()),
        T.StructField("slots", T.BinaryType()),
        T.StructField("own", T.BinaryType()),
    ]
)


def _gate_bits(text: bytes, code: Code, bits: list[int], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Bits of a text, evenly spread, each with its slots, and the text's own counts (by predictor, zeros and ones) in them. Two
    walks over the text, part by part."""

    def walk() -> Iterator[np.ndarray]:
        for part in parts_of(text, settings.count_bytes):
            keys = list(bit_keys([part], code, settings))
            yield np.stack([keys[0] & np.uint32(1), *[x >> np.uint32(32 - b) for x, b in zip(keys, bits, strict=True)]])

    total = int(code.length[np.frombuffer(text, np.uint8)].sum()) + int(code.length[END])
    stride, seen, picked = -(-total // settings.sample_bits), 0, []
    for found in walk():
        picked.append(found[:, -seen % stride :: stride])
        seen += found.shape[1]
    chosen = np.concatenate(picked, axis=1)
    kinds = [np.unique(c, return_inverse=True) for c in chosen[1:]]
    sums = [np.zeros((2, len(k)), np.uint32) for k, _ in kinds]
    for found in walk():
        for x, (k, _), n in zip(found[1:], kinds, sums, strict=True):
            at = np.searchsorted(k, x).clip(max=len(k) - 1)
            hit = k[at] == x
            for b in (0, 1):
                n[b] += np.bincount(at[hit & (found[0] == b)], minlength=len(k)).astype(np.uint32)
    return chosen, np.stack([n[:, where] for n, (_, where) in zip(sums, kinds, strict=True)])


def gate_sample(training: DataFrame, code: Code, bits: list[int], total: int, settings: Settings) -> list:
    """For some training documents, chosen and ordered by their rows' hashes, some of their bits, evenly spread: the bit, its slots, and
    the document's own counts (zeros, ones) there. About sample_docs rows, of at most sample_bits bits each; none by default."""
    want = settings.sample_docs
    if not want:
        return []
    key = F.xxhash64("doc_id", "text")
    some = F.pmod(key, F.lit(1 << 30)) < int((1 << 30) * min(1.0, want / max(total, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("hash").to_pylist(), batch.column("text").to_pylist(), strict=True):
                chosen, own = _gate_bits(plain(text), code, bits, settings)
                columns = [pa.array([key]), *[pa.array([a.tobytes()], pa.binary()) for a in (chosen[0].astype(np.uint8), chosen[1:], own)]]
                yield pa.RecordBatch.from_arrays(columns, names=GATE.names)

    found = training.where(some).select(key.alias("hash"), "text").mapInArrow(run, GATE)
    return found.orderBy("hash", "slots").limit(4 * want).collect()


def fit_weights(seen: np.ndarray, sample: list, counts: list[np.ndarray], wanted: list[np.ndarray], settings: Settings) -> np.ndarray:
    """Weights by predictor and confidence: from all training bits, seen by predictor as left_out() gives them; where there is a
    sample, a ridge logistic regression over its bits."""
    k = len(wanted)
    start = np.full(k * 8, 1.0 / k)
    if not sample:
        return settings.share * single_weights(seen)
    bit = np.concatenate([np.frombuffer(r["bit"], np.uint8) for r in sample])
    slots = np.concatenate([np.frombuffer(r["slots"], np.uint32).reshape(k, -1) for r in sample], axis=1)
    own = np.concatenate([np.frombuffer(r["own"], np.uint32).reshape(k, 2, -1) for r in sample], axis=2)
    y, x = bit.astype(float), np.zeros((len(bit), k * 8), np.float32)
    for j in range(k):
        found = codes((counts[j][:, np.searchsorted(wanted[j], slots[j])] - own[j]).clip(0))
        x[np.arange(len(bit)), j * 8 + (found >> 5)] = ODDS[found & 31]
    return _fit(x, y, start, 10.0).reshape(k, 8)


def single_weights(seen: np.ndarray, pull: float = 10.0, most: float = 4.0) -> np.ndarray:
    """By predictor and confidence the weight of least log loss of that predictor alone, with a pull towards 1: the zero of a
    slope that grows with the weight, between 0 and most."""
    zeros, ones = np.moveaxis(seen.reshape(len(seen), 2, 8, 32), 1, 0)
    low, high = np.zeros(zeros.shape[:2]), np.full(zeros.shape[:2], most)
    for _ in range(40):
        w = (low + high) / 2
        p = 1 / (1 + np.exp(-w[..., None] * ODDS))
        up = ((p * zeros - (1 - p) * ones) * ODDS).sum(axis=-1) + pull * (w - 1) > 0
        low, high = np.where(up, low, w), np.where(up, w, high)
    return (low + high) / 2


def _fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray, pull: float) -> np.ndarray:
    """The weights of least log loss, with a pull towards the prior: damped Newton steps."""
    w, blocks = prior, [slice(a, a + 65536) for a in range(0, len(y), 65536)]

    def loss(w: np.ndarray) -> float:
        return sum(np.logaddexp(0, (1 - 2 * y[b]) * (x[b] @ w)).sum() for b in blocks) + pull / 2 * ((w - prior) ** 2).sum()

    now = loss(w)
    for _ in range(12):
        slope, curve = pull * (w - prior), pull * np.eye(len(w))
        for b in blocks:
            p = 1 / (1 + np.exp(-np.clip(x[b] @ w, -40, 40)))
            slope = slope + x[b].T @ (p - y[b])
            curve += (x[b] * (p * (1 - p))[:, None]).T @ x[b]
        step = np.linalg.solve(curve, slope)
        size = 1.0
        while size > 1e-3 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-6 * before:
            break
    return w


def packed_votes(tables: list[np.ndarray], weights: np.ndarray) -> list[bytes]:
    """The votes of all tables, one table after the other, compressed piece by piece: half of the slots or more are empty."""
    pack = zstandard.ZstdCompressor(level=1)
    return [pack.compress(vote_of(w)[t[at : at + (1 << 24)]]) for t, w in zip(tables, weights, strict=True) for at in range(0, len(t), 1 << 24)]


def mapped_votes(name: str, packed: Broadcast, bits: list[int]) -> list[np.ndarray]:
    """The votes of each predictor, mapped from a file that the workers of an executor share: memory holds the pages in use
    once for all of them. The first worker that needs the file writes it."""
    path = os.path.join(os.path.abspath(SparkFiles.getRootDirectory()), name)
    with open(f"{path}.lock", "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        if not os.path.exists(path):
            unpack = zstandard.ZstdDecompressor()
            with open(f"{path}.part", "wb") as out:
                for piece in packed.value:
                    out.write(unpack.decompress(piece))
            os.rename(f"{path}.part", path)
    flat = np.asarray(np.memmap(path, np.int8, "r"))
    return np.split(flat, np.cumsum([1 << b for b in bits])[:-1])


SCORED = T.StructType(
    [
        T.StructField("row", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("known", T.LongType()),
        T.StructField("base", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("rare", T.ArrayType(T.LongType())),
    ]
)


def _least(words: DataFrame, most: int) -> int:
    """The least count at which at most so many words are as frequent: from a histogram of counts in steps of an eighth of
    a doubling, some hundred rows whatever the number of words."""
    step = F.floor(F.log2("n") * 8).alias("s")
    rows = words.select(step, "n").groupBy("s").agg(F.count("*").alias("k"), F.min("n").alias("n")).collect()
    total, least = 0, 1 << 62
    for row in sorted(rows, key=lambda r: -r["s"]):
        total += row["k"]
        if total > most:
            break
        least = row["n"]
    return least


def score_documents(docs: DataFrame, training: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of each row of docs (doc_id, text).

    training has rows (doc_id, text) too."""
    spark = docs.sparkSession
    training = training.select("doc_id", "text")
    counts = settle(tally(training, settings))
    symbols = np.zeros(257, np.int64)
    for row in counts.where("kind = 1").collect():  # 257 rows at most
        symbols[int(bytes(row["key"]))] = row["n"]
    code = Code(symbols)
    n_train = int(symbols[END])
    words = counts.where("kind = 0 AND length(key) > 0").select("hash", "n")
    n_all, n_kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_all, n_kinds, n_words = n_all + n_train, n_kinds + (n_train > 0), n_kinds  # with the end
    found = words.where(F.col("n") >= _least(words, settings.head_words)).toPandas()  # head_words at most
    found = found.sort_values(["n", "hash"], ascending=[False, True])
    head = found["hash"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    whole = n_words == len(found)

    parts = part_bits(int(symbols.sum()))
    slots = [0] * len(settings.contexts)
    if n_train:
        contexts = settle(count_contexts(training, code, parts, settings))
        for row in contexts.groupBy(F.shiftright("part", parts).alias("k")).agg(F.sum("slots").alias("n")).collect():  # one a predictor
            slots[row["k"]] = row["n"]
    bits = [table_bits(n, parts) for n in slots]
    tables, sample, known_at, wanted = [np.full(1 << b, EMPTY, np.uint8) for b in bits], [], [], [np.zeros(0, np.int64)] * len(bits)
    seen = np.zeros((len(bits), 2, 256))
    if n_train:
        sample = gate_sample(training, code, bits, n_train, settings)
        if sample:
            found = np.concatenate([np.frombuffer(r["slots"], np.uint32).reshape(len(bits), -1) for r in sample], axis=1)
            wanted = [np.unique(x).astype(np.int64) for x in found]
            known_at = counts_at(contexts, parts, bits, wanted)
        unpack = zstandard.ZstdDecompressor()
        for row in quantised(contexts, parts, bits).toLocalIterator():  # one part at a time
            k, j = row["part"] >> parts, row["part"] & (1 << parts) - 1
            size = len(tables[k]) >> parts
            tables[k][j * size : (j + 1) * size] = np.frombuffer(unpack.decompress(row["data"]), np.uint8)
            seen[k] += np.frombuffer(row["seen"]).reshape(2, 256)
    weights = fit_weights(seen, sample, known_at, wanted, settings)
    name, packed = f"lm-{uuid.uuid4().hex}", spark.sparkContext.broadcast(packed_votes(tables, weights))
    floor = n_all + n_kinds + 1
    shared = spark.sparkContext.broadcast((code, bits, head))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, bits, head = shared.value
        mixer = Mixer(code, mapped_votes(name, packed, bits), settings)
        context = TaskContext.get()
        row = (context.partitionId() if context else 0) << 40
        known_words, hasher = Head(*head, n_train, floor, settings.probe_bits), WordHasher()
        unseen = float(np.log10(1 / floor))
        for batch in slices(batches):
            texts = [plain(t) for t in batch.column("text").to_pylist()]
            parts: list[tuple[np.ndarray, ...]] = []
            for group in _groups(iter(texts), 1 << 18):
                pieces = [word_pieces(t, 1 << 20) for t in group]
                extra = np.array([len(p) - 1 for p in pieces])  # ends that look_up adds for pieces that are no texts
                found = [known_words.look_up(hasher.split(some)) for some in _groups((p for own in pieces for p in own), 1 << 20)]
                base, known, rare, others = (np.concatenate(x) for x in zip(*found, strict=True))
                first = np.cumsum(extra + 1) - extra - 1
                base, known, others = (np.add.reduceat(x, first) for x in (base, known, others))
                base, known = base - extra * known_words.end, known - extra * known_words.seen_end
                n_words = known - known_words.seen_end + others
                if whole:  # what is not known was never seen
                    base, rare, others = base + unseen * others, rare[:0], others * 0
                parts.append((n_words + 1, known, base, rare.view(np.int64), others))
            n_tokens, known, base, rare, others = (np.concatenate(x) for x in zip(*parts, strict=True))
            borders = pa.array(np.concatenate([[0], np.cumsum(others)]).astype(np.int32))
            sizes = np.array([len(t) for t in texts], np.int64)
            numbers = [row + np.arange(len(texts)), n_tokens, known, base, mixer.score(texts), sizes]
            row += len(texts)
            first, *others_ = [pa.array(np.asarray(x)) for x in numbers]
            yield pa.RecordBatch.from_arrays([first, batch.column("doc_id"), *others_, pa.ListArray.from_arrays(borders, pa.array(rare))], names=SCORED.names)

    scored = docs.select("doc_id", "text").mapInArrow(run, SCORED)
    known, base = F.col("known"), F.col("base")
    if not whole:
        scored = settle(scored)  # row numbers hold from here on
        rare = scored.select("row", F.explode("rare").alias("hash")).join(words, "hash", "left").withColumn("c", F.coalesce("n", F.lit(0)))
        rare = rare.groupBy("row").agg(
            F.count_if(F.col("c") > 0).alias("more"),
            F.sum(F.log10((F.col("c") + 1) / F.lit(float(floor)))).alias("rest"),
        )
        scored = scored.drop("rare").join(rare, "row", "left")
        known, base = known + F.coalesce("more", F.lit(0)), base + F.coalesce("rest", F.lit(0.0))
    return scored.select(
        "doc_id",
        "n_tokens",
        known.cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
        (-F.col("score") * float(np.log2(10)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
