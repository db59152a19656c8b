"""Near-duplicate groups by MinHash, banding and odd sketches.

A document's set holds the hashes of its distinct five-word shingles. Documents with the same set are one class; classes
are linked if the similarity of their sets reaches the threshold. The steps:

1. One pass over the texts gives each document its set's size and fingerprint, MinHash bands and odd sketch. The set
   itself is not kept.
2. Classes that share a band lie in a bucket. First each class is paired with one other of its buckets, the most famous,
   so a group of n near copies gives n - 1 pairs, not n squared.
3. A pair whose sketches differ in too many bits is dropped: every unequal MinHash value flips two bits at most, and
   the bound leaves the loss of a true link below one in a million. The others are confirmed on their full sets.
4. Confirmed links give components. Buckets that still hold several components may hide links between them: there, finer
   sketches tell near from not near enough; classes are paired with the most famous of each bucket, and what is then
   still apart is joined, component against component, under the finer bound; a bucket's one side is split and its other
   side repeated by its size, so that no task holds a large bucket. A link inside a component can't change it and isn't
   sought.
5. Components are found by alternating stars over tables in the shared folder; nothing is gathered on the driver.

Defined results. A null or empty text, or one without words, has an empty set, is linked with nothing and is its own
component. A text of one to four words has one shingle, the whole sequence. Very long texts count whole. Rows that repeat
an id are rows of one document: each is returned, and texts of one id count as linked. A row with a null id is never
named by others: alone it has a null component_id and is kept; with the same set as others it has their component.
An empty table gives an empty result. kept means that doc_id is the component's id (or both are null).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import hold, settle, slices, small_batches
from strandline.llm.words import WordHasher, constants, plain, scramble

_U = np.uint64


@dataclass(frozen=True)
class Settings:
    shingle_words: int = 5
    percent: int = 85  # least similarity of a link, in hundredths
    bands: int = 24
    rows: int = 5  # MinHash values of a band: a pair at the threshold is missed once in 1.3 million
    sketch_words: int = 8  # of 64 bits
    sketch_bits: int = 80  # most bits in which sketches of a pair may differ: 40 unequal values of 120, 6 sigma from 18
    fine_values: int = 1024  # MinHash values and words of the finer sketches that buckets of several components get
    fine_words: int = 32
    fine_bits: int = 364  # at the threshold 265 on average, with a deviation of 19; 0.75 gives 400 or so
    filter_bits: int = 26  # most bits of the bitmap of ids, as a power of two: 8 MB
    split_rows: int = 2_000  # of a bucket's classes that one task joins with the others of the bucket
    chunk_bytes: int = 1 << 18  # of texts hashed at once


class Hasher:
    """Shingle sets and their digests, by whole-array arithmetic modulo 2 ** 64."""

    def __init__(self, settings: Settings = Settings()) -> None:
        self.settings = s = settings
        self.words = WordHasher()
        self.place = constants(2, s.shingle_words)
        self.factors = constants(3, s.bands * s.rows)

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """The sorted distinct shingle hashes of each text."""
        out: list[np.ndarray] = []
        chunk: list[bytes] = []
        size = 0
        for text in texts:
            chunk.append(plain(text))
            size += len(chunk[-1]) + 1
            if size >= self.settings.chunk_bytes:
                out += self._sets(chunk)
                chunk, size = [], 0
        return out + self._sets(chunk)

    def _sets(self, texts: list[bytes]) -> list[np.ndarray]:
        if not texts:
            return []
        with np.errstate(over="ignore"):
            found = self.words.split(texts)
            words = found.hashes
            k = self.settings.shingle_words
            n = max(len(words) - k + 1, 0)
            shingles = np.zeros(n, np.uint64)
            for j in range(k):
                shingles += words[j : j + n] * self.place[j]
            shingles = scramble(shingles)
            out = []
            for a, z in zip(found.borders[:-1].tolist(), found.borders[1:].tolist(), strict=True):
                if z - a >= k:
                    out.append(np.unique(shingles[a : z - k + 1]))
                elif z > a:  # the words there are, marked by their number
                    out.append(scramble((words[a:z] * self.place[: z - a]).sum(keepdims=True) + _U(z - a)))
                else:
                    out.append(np.zeros(0, np.uint64))
            return out

    def minima(self, sets: list[np.ndarray], factors: np.ndarray) -> np.ndarray:
        """The mixed MinHash values of non-empty sets, a row for each set."""
        n = len(sets)
        out = np.empty((n, len(factors)), np.uint64)
        with np.errstate(over="ignore"):
            at = 0
            while at < n:  # as many sets at once as stay in the processor's cache
                stop, size = at, 0
                while stop < n and (size < 16384 or stop == at):
                    size += len(sets[stop])
                    stop += 1
                flat = np.concatenate(sets[at:stop])
                first = np.cumsum([0, *map(len, sets[at : stop - 1])])
                for j, factor in enumerate(factors):
                    out[at:stop, j] = np.minimum.reduceat(flat * factor, first)
                at = stop
            place = constants(5, len(factors))
            return scramble(out * place + place)

    @staticmethod
    def odd_sketch(values: np.ndarray, words: int) -> np.ndarray:
        """Parity bitmaps: each value (its place is mixed in) toggles one bit of its row."""
        bit = values % _U(words * 64)
        sketch = np.zeros((len(values), words), np.uint64)
        rows = np.arange(len(values))
        for j in range(values.shape[1]):
            sketch[rows, (bit[:, j] >> _U(6)).astype(np.int64)] ^= _U(1) << (bit[:, j] & _U(63))
        return sketch

    def digests(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of non-empty sets: two-number fingerprints, band hashes and odd sketches, a row for each set."""
        s, n = self.settings, len(sets)
        values = self.minima(sets, self.factors)
        prints = np.empty((n, 2), np.uint64)
        with np.errstate(over="ignore"):
            for i, x in enumerate(sets):
                prints[i] = scramble(x).sum(), scramble(x ^ _U(0x5851F42D4C957F2D)).sum()
            bands = scramble(values.reshape(n, s.bands, s.rows).sum(axis=2) + np.arange(s.bands, dtype=np.uint64))
        return prints, bands, self.odd_sketch(values, s.sketch_words)

    def fine_sketches(self, sets: list[np.ndarray]) -> np.ndarray:
        """Odd sketches of many values; a set that is empty has an empty one."""
        s = self.settings
        out = np.zeros((len(sets), s.fine_words), np.uint64)
        full = [i for i, x in enumerate(sets) if len(x)]
        factors = constants(6, s.fine_values)
        for at in range(0, len(full), 512):
            rows = full[at : at + 512]
            out[rows] = self.odd_sketch(self.minima([sets[i] for i in rows], factors), s.fine_words)
        return out


FEATURES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("p0", T.LongType()),
        T.StructField("p1", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType(), False)),
        T.StructField("sketch", T.ArrayType(T.LongType(), False)),
    ]
)
SETS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("shingles", T.ArrayType(T.LongType(), False)),
        T.StructField("fine", T.ArrayType(T.LongType(), False)),
    ]
)


def _long_lists(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(rows.view(np.int64).ravel()))


def features(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """FEATURES of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(settings)
        for batch in slices(batches):
            sets = hasher.sets(batch.column("text").to_pylist())
            sizes = np.array([len(x) for x in sets], np.int64)
            full = np.flatnonzero(sizes)
            prints = np.zeros((len(sets), 2), np.uint64)
            bands = np.zeros((len(sets), settings.bands), np.uint64)
            sketch = np.zeros((len(sets), settings.sketch_words), np.uint64)
            if len(full):
                prints[full], bands[full], sketch[full] = hasher.digests([sets[i] for i in full])
            p = prints.view(np.int64)
            columns = [batch.column("doc_id"), pa.array(sizes), pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())]
            yield pa.RecordBatch.from_arrays([*columns, _long_lists(bands), _long_lists(sketch)], names=FEATURES.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FEATURES)


def shingle_sets(docs: DataFrame, ids: DataFrame, settings: Settings = Settings(), *, fine: bool = False, repeated: bool = True) -> DataFrame:
    """id, shingles and (empty unless asked for) the finer sketch of the docs (doc_id, text) named in ids (id).

    The texts are passed once more, without a shuffle; only the sets of named ids (and of the few others that a bitmap of
    hashed ids lets through) are made. Ids too many for a bitmap of bounded size meet the texts in a join instead. Where ids
    may be repeated, equal sets of an id become one."""
    n = ids.count()
    if 16 * n < 1 << settings.filter_bits:
        size, bitmap = _filter_of(ids, n)
    else:
        docs = docs.join(ids.select(F.col("id").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
        size, bitmap = 64, np.full(1, -1, np.int64)
    bit = F.xxhash64("doc_id").bitwiseAND(F.lit(size - 1)).alias("bit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(settings)
        for batch in slices(batches):
            bit = batch.column("bit").to_numpy()
            batch = batch.filter(pa.array((bitmap[bit >> 6] >> (bit & 63)) & 1 == 1))
            sets = hasher.sets(batch.column("text").to_pylist())
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            borders = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            sketch = hasher.fine_sketches(sets) if fine else np.zeros((len(sets), 0), np.uint64)
            columns = [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(borders), pa.array(flat)), _long_lists(sketch)]
            yield pa.RecordBatch.from_arrays(columns, names=SETS.names)

    sets = docs.select("doc_id", "text", bit).mapInArrow(run, SETS)
    return hold(sets.dropDuplicates(["id", "shingles"]) if repeated else sets)


def _near(words: int, most: int, a: str = "sa", b: str = "sb") -> Column:
    """Whether two sketches differ in so few bits that a link is possible."""
    bits = [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(words)]
    return sum(bits[1:], bits[0]) <= most


def _like_sizes(settings: Settings) -> Column:
    """Whether sets of na and nb elements can reach the threshold at all."""
    return (100 * F.col("na") >= settings.percent * F.col("nb")) & (100 * F.col("nb") >= settings.percent * F.col("na"))


def _side(classes: DataFrame, name: str) -> DataFrame:
    return classes.select(F.col("id").alias(name), F.col("n_shingles").alias(f"n{name}"), F.col("sketch").alias(f"s{name}"))


def _sketched(pairs: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link."""
    both = pairs.join(_side(classes, "b"), "b").join(_side(classes, "a"), "a")
    return both.where(_like_sizes(settings) & _near(settings.sketch_words, settings.sketch_bits)).select("a", "b").distinct()


#: A similarity of 0.8 instead of 0.85: 36 bands miss a pair at the threshold once in 1.6 million; the sketches' bounds follow as in
#: Settings (36 unequal values of 180 on average, with a deviation of 5.4; 338 finer bits, with one of 19).
FOUR_FIFTHS = Settings(percent=80, bands=36, sketch_bits=136, fine_bits=437)


def _filter_of(ids: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """A bitmap of n hashed ids: its size in bits, sixteen or more for each, and its words, which come to the driver."""
    size = 1 << max(10, (16 * n).bit_length())
    bit = F.xxhash64("id").bitwiseAND(F.lit(size - 1))
    words = ids.select(F.shiftright(bit, 6).alias("w"), F.expr("shiftleft(1L, cast(xxhash64(id) & 63 as int))").alias("m"))
    bitmap = np.zeros(size >> 6, np.int64)
    for row in words.groupBy("w").agg(F.bit_or("m").alias("m")).toLocalIterator():
        bitmap[row["w"]] = row["m"]
    return size, bitmap


def confirm(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) of ids whose full sets (id, shingles) reach the threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(right, "b").join(left, "a")
    shared = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("t"))
    return shared.where(100 * F.col("i") >= settings.percent * (F.col("t") - F.col("i"))).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of every id in links (a, b), by alternating large and small stars."""
    edges = settle(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # Small stars: every id with its smaller neighbours, all joined to the smallest of them.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y"))
        edges = settle(small.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("b").alias("id"), F.col("a").alias("component"))
        state = now


def _crowd(classes: DataFrame) -> DataFrame:
    """Rows (key, place, id, fame) of the buckets of several classes. An id's fame is the size of all its buckets: the classes
    nearest to the middle of a group share most bands with the others."""
    banded = classes.select("id", F.posexplode("bands").alias("place", "key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("_x"), F.max("id").alias("_y"))
    rows = banded.join(shared.where("_x <> _y").select("key", "n"), "key")
    return rows.select("key", "place", "id").join(rows.groupBy("id").agg(F.sum("n").alias("fame")), "id")


def link_classes(classes: DataFrame, docs: DataFrame, settings: Settings, *, repeated: bool = True) -> DataFrame:
    """id and component of the classes (id, n_shingles, bands, sketch) that are linked to others. repeated: whether docs has
    several rows of an id."""
    crowd = settle(_crowd(classes))
    star = F.max(F.struct("fame", (-F.col("id")).alias("id")))  # the most famous, of equals the smallest id
    # First each class with one other: the most famous of all in its buckets.
    centres = crowd.groupBy("key").agg(star.alias("m"))
    stars = crowd.join(centres, "key").groupBy(F.col("id").alias("b")).agg((-F.max("m")["id"]).alias("a"))
    pairs = settle(_sketched(stars.where("a <> b"), classes, settings))
    named = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    links = settle(confirm(pairs, shingle_sets(docs, named, settings, repeated=repeated), settings))
    found = components(links)

    # Then what buckets of several components hold, under finer sketches: first with the most famous of each bucket.
    labelled = crowd.join(found, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    split = labelled.groupBy("key").agg(F.min("c").alias("_x"), F.max("c").alias("_y"), star.alias("m")).where("_x <> _y")
    rest = settle(labelled.join(split.select("key", "m"), "key"))
    sets = shingle_sets(docs, rest.select("id").distinct(), settings, fine=True, repeated=repeated)
    finer = classes.select("id", "n_shingles", "bands").join(sets.select("id", F.col("fine").alias("sketch")), "id")
    side = lambda n: finer.select(F.col("id").alias(n), F.col("n_shingles").alias(f"n{n}"), F.col("sketch").alias(f"s{n}"))
    near = _like_sizes(settings) & _near(settings.fine_words, settings.fine_bits)
    stars = rest.select((-F.col("m.id")).alias("a"), F.col("id").alias("b")).where("a <> b").distinct()
    stars = stars.join(side("b"), "b").join(side("a"), "a").where(near).select("a", "b").distinct()
    links = settle(links.unionByName(confirm(stars, sets, settings)))
    found = components(links)

    # Last all pairs of different components that such buckets still hold, each pair in the first band it shares.
    labelled = rest.select("key", "place", "id").join(found, "id", "left").withColumn("c", F.coalesce("component", "id"))
    split = labelled.groupBy("key").agg(F.min("c").alias("_x"), F.max("c").alias("_y"), F.count("*").alias("_n")).where("_x <> _y")
    split = split.select("key", F.ceil(F.col("_n") / settings.split_rows).cast("int").alias("shares"))
    left = settle(labelled.select("key", "place", "id", "c").join(split, "key").join(finer, "id"))

    def one(n: str, share: Column) -> DataFrame:
        fields = (("k", "key"), ("", "id"), ("c", "c"), ("n", "n_shingles"), ("s", "sketch"), ("b", "bands"), ("p", "place"))
        return left.select(share.alias(f"h{n}"), *[F.col(c).alias(f"{k}{n}") for k, c in fields])

    own = F.pmod(F.xxhash64("id"), F.col("shares")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("shares") - 1))
    first = F.array_position(F.zip_with("ba", "bb", lambda x, y: x == y), True) == F.col("pa") + 1
    here = (F.col("ka") == F.col("kb")) & (F.col("ha") == F.col("hb")) & (F.col("ca") < F.col("cb")) & near & first
    pairs = settle(one("a", own).join(one("b", every), here).select("a", "b").distinct())
    if pairs.isEmpty():
        return found
    return components(links.unionByName(confirm(pairs, sets, settings)))


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_shingles, component_id and kept."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = hold(features(docs, settings))
    prints = ["p0", "p1", "n_shingles"]
    full = found.where("n_shingles > 0")
    classes = settle(
        full.groupBy(*prints)
        .agg(F.min("doc_id").alias("id"), F.max("doc_id").alias("_last"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    )
    repeated = not full.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").isEmpty()
    known = classes.where("id IS NOT NULL").select("id", "n_shingles", "bands", "sketch")
    linked = link_classes(known, docs, settings, repeated=repeated)
    named = classes.select(*prints, "id").join(linked, "id", "left").select(*prints, F.coalesce("component", "id").alias("component_id"))
    out = found.select("doc_id", *prints).join(named, prints, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
