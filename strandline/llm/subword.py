"""SentencePiece encoding and decoding by a shared-prefix forward pass.

Text is marked (a leading mark, spaces as marks) and cut into marked words that no piece can cross. The distinct words of
a batch are sorted, which is a depth-first walk of their trie, and the forward pass keeps its state for each prefix: a
word starts where its common prefix with the word before it ends.

The forward state of a prefix depends on the kind of model:
  unigram  the best score of the prefix and its last piece (Viterbi).
  bpe      the last piece of the prefix. A sequence of pieces is what merging gives exactly if every neighbouring pair is
           what merging gives for the pair's own text, so each prefix has one possible last piece, found by testing the
           pieces that end there against the state of the shorter prefix. Pair tests are kept.
Both give the ids of the public library for models with identity normalisation (checked when the model is read).

Defined results. A null or empty text has no ids and decodes to the empty text. Characters without a piece become their
UTF-8 bytes, or the unknown id in models without bytes. A text that holds the mark itself (U+2581) decodes with a space
there, as in the library; round_trip is then false. Very long texts and words are encoded whole, in linear time.
Repeated rows get equal ids; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from struct import Struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
_ROOT, _NONE = -2, -1  # states: no piece yet; a character without a piece


@dataclass(frozen=True)
class Settings:
    model: str = "/opt/tokenizers/piece_bpe_32k.model"
    batch_chars: int = 4_000_000  # of texts whose words are sorted together
    kept_words: int = 400_000  # encoded words kept between batches; begun anew beyond
    kept_pairs: int = 2_000_000  # tested pairs kept; begun anew beyond


@dataclass
class Model:
    """Pieces in order of id, with their scores; byte_ids has the ids of the bytes 0 to 255, if the model has them."""

    pieces: list[str]
    scores: list[float]
    kind: str = "bpe"
    byte_ids: list[int] = field(default_factory=list)
    unknown: int = 0
    plain: frozenset[int] = frozenset()  # ids of pieces that stand for their own text

    @classmethod
    def read(cls, path: str) -> Model:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, kinds = proto.normalizer_spec, {1: "unigram", 2: "bpe"}
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("only models with identity normalisation, a leading mark and escaped spaces are supported")
        kind = kinds.get(proto.trainer_spec.model_type)
        if kind is None:
            raise ValueError("only unigram and bpe models are supported")
        if any(p.type == 4 for p in proto.pieces):
            raise ValueError("models with user-defined pieces are not supported")
        of = lambda wanted: [i for i, p in enumerate(proto.pieces) if p.type == wanted]
        return cls([p.piece for p in proto.pieces], [p.score for p in proto.pieces], kind, of(6), of(2)[0], frozenset(of(1)))


class Encoder:
    def __init__(self, model: Model, settings: Settings = Settings()) -> None:
        self.model, self.settings = model, settings
        self.ids = {model.pieces[i]: i for i in sorted(model.plain)}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a piece crosses words")
        #: Every ending of a piece: the piece's id, or -1 if the ending is none itself.
        self.tails: dict[str, int] = {}
        for piece in self.ids:
            for i in range(len(piece)):
                self.tails.setdefault(piece[i:], -1)
        self.tails.update(self.ids)
        apart = "" if any("\n" in p for p in self.ids) else "\\n"  # a character of no piece parts words as well
        self.split = re.compile(f"{MARK}*[^{MARK}{apart}]+|{MARK}+" + (f"|{apart}" if apart else ""))
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}  # the ids as packed numbers
        self.worst = min((model.scores[i] for i in model.plain), default=0.0) - 10.0
        #: The bytes that each id stands for.
        self.spelled = [p.encode() if i in model.plain else b"" for i, p in enumerate(model.pieces)]
        for byte, i in enumerate(model.byte_ids):
            self.spelled[i] = bytes([byte])

    def mark(self, text: str) -> list[str]:
        """The marked words of a text."""
        return self.split.findall(MARK + text.replace(" ", MARK)) if text else []

    def merge(self, text: str) -> list[str]:
        """Pieces by plain merging: the best-scored pair first, the leftmost of equals. For pairs of pieces only."""
        parts, ids, scores = list(text), self.ids, self.model.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or scores[found] > best):
                    best, at = scores[found], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, before: int, piece: int) -> bool:
        """Whether merging keeps the two pieces apart, or makes the piece at all if nothing it could join is before it."""
        key = (before + 2) << 32 | piece
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= self.settings.kept_pairs:
                self.pairs.clear()
            own = [self.model.pieces[i] for i in (before, piece) if i >= 0]
            found = self.pairs[key] = self.merge("".join(own)) == own
        return found

    def _encode_sorted(self, words: list[str]) -> None:
        """Adds the ids of words, given in order, to self.words."""
        bpe, pack = self.model.kind == "bpe", Struct("i").pack
        tails, pairs, scores = self.tails.get, self.pairs, self.model.scores
        last, start, score, before = [_ROOT], [0], [0.0], ""
        for word in words:
            n, same = len(word), 0
            for a, b in zip(before, word):
                if a != b:
                    break
                same += 1
            del last[same + 1 :], start[same + 1 :], score[same + 1 :]
            for i in range(same + 1, n + 1):
                piece, at, best = _NONE, i - 1, None
                for j in range(i - 1, -1, -1):
                    tail = tails(word[j:i])
                    if tail is None:
                        break
                    if tail < 0:
                        continue
                    if bpe:
                        found = pairs.get((last[j] + 2) << 32 | tail)
                        if found or found is None and self.fits(last[j], tail):
                            piece, at = tail, j
                            break
                    elif best is None or score[j] + scores[tail] > best:
                        piece, at, best = tail, j, score[j] + scores[tail]
                if not bpe and (best is None or word[i - 1] not in self.ids and score[i - 1] + self.worst > best):
                    piece, at, best = _NONE, i - 1, score[i - 1] + self.worst
                last.append(piece)
                start.append(at)
                score.append(best or 0.0)
            out, i = [], n
            while i:
                if last[i] >= 0:
                    out.append(last[i])
                elif self.model.byte_ids:
                    out.extend(self.model.byte_ids[b] for b in reversed(word[i - 1].encode()))
                elif not out or out[-1] != self.model.unknown:  # neighbouring unknown characters are one id
                    out.append(self.model.unknown)
                i = start[i]
            out.reverse()
            self.words[word] = pack(*out) if len(out) == 1 else array("i", out).tobytes()
            before = word

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.words) > self.settings.kept_words:
            self.words.clear()
        marked = [self.mark(t) for t in texts]
        self._encode_sorted(sorted({w for words in marked for w in words if w not in self.words}))
        known = self.words.__getitem__
        return [np.frombuffer(b"".join(map(known, words)), np.int32) for words in marked]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces and bytes joined, marks as spaces, without the leading one."""
        text = b"".join(map(self.spelled.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


_encoders: dict[Settings, Encoder] = {}


def encoder_of(settings: Settings) -> Encoder:
    """The encoder of this worker process."""
    if settings not in _encoders:
        _encoders[settings] = Encoder(Model.read(settings.model), settings)
    return _encoders[settings]


ENCODED = T.StructType(
    [
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("n_ids", T.LongType()),
        T.StructField("round_trip", T.BooleanType()),
    ]
)


def _chunks(texts: list[str], limit: int) -> Iterator[list[str]]:
    chunk, size = [], 0
    for t in texts:
        chunk.append(t)
        size += len(t)
        if size >= limit:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def encoder_column(settings: Settings = Settings()):
    """A column function of a text: a struct of ids, n_ids and round_trip (whether decoding gives the text again)."""

    @F.arrow_udf(ENCODED)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = encoder_of(settings)
        for batch in batches:
            for texts in _chunks([t or "" for t in batch.to_pylist()], settings.batch_chars):
                ids = encoder.encode(texts)
                good = [encoder.decode(i) == t for i, t in zip(ids, texts, strict=True)]
                sizes = np.array([len(i) for i in ids], np.int64)
                borders = np.concatenate([[0], sizes.cumsum()]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(borders), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.StructArray.from_arrays([lists, pa.array(sizes), pa.array(good, pa.bool_())], names=ENCODED.names)
        encoder.words.clear()  # the process goes on to other work; only the tested pairs are worth their memory

    return encode


def decoder_column(settings: Settings = Settings()):
    """A column function of an array of ids: the text."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = encoder_of(settings)
        for batch in batches:
            yield pa.array([encoder.decode(np.array(ids or [], np.int64)) for ids in batch.to_pylist()], pa.string())

    return decode


def encode_texts(docs: DataFrame, settings: Settings = Settings(), *, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns in keep with ids, n_ids and round_trip of each text."""
    return docs.select(*keep, encoder_column(settings)(text).alias("_e")).select(*keep, "_e.*")
