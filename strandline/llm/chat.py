"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole by one template, encoded once with offsets, and the sorted spans of its turns are
intersected with the token spans by binary search. The template's markers are special tokens of the encoder, so no token
crosses the border between a marker and a text, and no other special token is known to it.

Template: for each turn <|turn|>role<|text|>text<|end|>. Control strings (the markers, and the strings that public
templates and tokenizers reserve) are escaped inside roles and texts by a backslash after their first character. A
control string counts as such with backslashes between its characters too, and gets one more; what backslashes are added
or taken away never changes which places count, so escaping is reversible for every text.

Defined results. Turns are taken by turn number, ties by role and then text, nulls first; a null text or role is the
empty one. Repeated rows are turns of their own. A row with a null conv_id belongs to no conversation and is formatted
by itself, under a null id. Empty and very long texts are rendered whole, runs of white space of any length included; an
empty table gives an empty result. A conversation is one training example and is assembled in one task: its size, not
the number of conversations, bounds memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm import byte_bpe

TURN, TEXT, END = MARKERS = ("<|turn|>", "<|text|>", "<|end|>")

#: Strings that public templates and tokenizers reserve.
RESERVED = (
    "<s>", "</s>", "<unk>", "<pad>", "<mask>", "<bos>", "<eos>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<start_of_turn>", "<end_of_turn>", "[CLS]", "[SEP]", "[PAD]", "[MASK]", "[UNK]",
    "<|endoftext|>", "<|startoftext|>", "<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|system|>", "<|user|>", "<|assistant|>",
    "<|begin_of_text|>", "<|end_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<|eom_id|>",
    "<|fim_prefix|>", "<|fim_middle|>", "<|fim_suffix|>", "<|endofprompt|>",
)


class Escaper:
    """Marks control strings inside texts, and takes the marks away again."""

    def __init__(self, control: tuple[str, ...]) -> None:
        if any("\\" in c or len(c) < 2 for c in control):
            raise ValueError("control strings have two characters or more, and no backslash")
        by_first: dict[str, list[str]] = {}
        for c in sorted(set(control)):
            by_first.setdefault(c[0], []).append(r"\\*" + r"\\*".join(map(re.escape, c[1:])))
        rest = {c: "(?:" + "|".join(r) + ")" for c, r in by_first.items()}
        self._escape = re.compile("|".join(f"{re.escape(c)}(?={r})" for c, r in rest.items()))
        self._unescape = re.compile("|".join(rf"{re.escape(c)}\\(?={r})" for c, r in rest.items()))

    def escape(self, text: str) -> str:
        return self._escape.sub(lambda m: m[0] + "\\", text)

    def unescape(self, text: str) -> str:
        return self._unescape.sub(lambda m: m[0][0], text) if "\\" in text else text


_OWN = Escaper(MARKERS + RESERVED)
escape, unescape = _OWN.escape, _OWN.unescape
_RENDERED = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.DOTALL)

FORMATTED = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("formatted", T.StringType()),
        T.StructField("token_ids", T.ArrayType(T.IntegerType())),
        T.StructField("starts", T.ArrayType(T.IntegerType())),
        T.StructField("ends", T.ArrayType(T.IntegerType())),
        T.StructField("loss_mask", T.ArrayType(T.ByteType())),
    ]
)


@dataclass(frozen=True)
class Settings:
    ranks: str = byte_bpe.RANKS
    loss_roles: tuple[str, ...] = ("assistant",)
    batch_chars: int = 1_000_000  # of conversations in one batch of the output


def render(turns: list[tuple[str, str]], loss_roles: tuple[str, ...]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one string, and the sorted spans of the texts to learn from."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role in loss_roles and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    return [(unescape(role), unescape(text)) for role, text in _RENDERED.findall(formatted)]


def mask_tokens(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """1 for the tokens that lie in a span. Both lists are sorted; each border is found by binary search."""
    mask = np.zeros(len(starts), np.int8)
    if spans:
        begin, stop = np.array(spans).T
        for a, z in zip(np.searchsorted(starts, begin, "left").tolist(), np.searchsorted(ends, stop, "right").tolist(), strict=True):
            mask[a:z] = 1
    return mask


def loss_texts(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """The texts under the mask, unescaped, one for each run of masked tokens."""
    on = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
    return [unescape(formatted[starts[a] : ends[b - 1]]) for a, b in on.reshape(-1, 2)]


def conversations(rows: DataFrame) -> DataFrame:
    """One row for each conv_id, its turns as a sorted array of (turn, role, text). Rows without one stay apart."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    grouped = rows.select("conv_id", own.alias("_own"), turn.alias("_turn")).groupBy("conv_id", "_own")
    return grouped.agg(F.sort_array(F.collect_list("_turn")).alias("turns")).drop("_own")


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts), kind))


def _batch(encoder: byte_bpe.ByteBpe, group: list[tuple]) -> pa.RecordBatch:
    ids, starts, ends, masks = [], [], [], []
    for _, text, spans in group:
        found = encoder.encode(text)
        a, z = byte_bpe.char_spans(text, encoder.borders(found))
        for column, value in zip((ids, starts, ends, masks), (found, a, z, mask_tokens(a, z, spans)), strict=True):
            column.append(value)
    arrays = [pa.array([c for c, _, _ in group], pa.int64()), pa.array([t for _, t, _ in group], pa.string())]
    arrays += [_lists(c, pa.int32()) for c in (ids, starts, ends)] + [_lists(masks, pa.int8())]
    return pa.RecordBatch.from_arrays(arrays, names=FORMATTED.names)


def _formatted(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[pa.RecordBatch]:
    """Output batches, of bounded size unless one conversation is larger, of the rows that conversations() gives."""
    encoder = byte_bpe.ByteBpe(settings.ranks, special=MARKERS)
    for batch in batches:
        turns, flat = batch.column("turns"), batch.column("turns").flatten()
        borders = (turns.offsets.to_numpy() - turns.offsets[0].as_py()).tolist()
        roles, texts = flat.field("role"), flat.field("text")
        group, size = [], 0
        for conv, a, z in zip(batch.column("conv_id").to_pylist(), borders[:-1], borders[1:], strict=True):
            said = list(zip(roles[a:z].to_pylist(), texts[a:z].to_pylist(), strict=True))
            group.append((conv, *render(said, settings.loss_roles)))
            size += len(group[-1][1])
            if size >= settings.batch_chars:
                yield _batch(encoder, group)
                group, size = [], 0
        if group:
            yield _batch(encoder, group)


def format_conversations(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """For each conversation of rows (conv_id, turn, role, text): its string, token ids, offsets and loss mask."""
    return _over(rows, lambda batches: _formatted(batches, settings), FORMATTED)


def _over(rows: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    return conversations(rows).mapInArrow(run, schema)


DIGEST = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("loss_tokens", T.LongType()),
    ]
)


def digest(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> tuple:
    """What can be read back from one output row."""
    turns = read_back(formatted)
    loss = "".join(loss_texts(formatted, starts, ends, mask))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    said = "".join(f"{role}\n{text}\n" for role, text in turns)
    return len(turns), sha(said), len(loss), sha(loss), len(formatted), len(mask), int(mask.sum())


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest rows of output batches."""
    for batch in batches:
        lists = [batch.column(c) for c in ("starts", "ends", "loss_mask")]
        flat = [c.flatten().to_numpy() for c in lists]
        borders = lists[0].offsets.to_numpy() - lists[0].offsets[0].as_py()
        rows = [
            (conv, *digest(text, *[f[a:z] for f in flat]))
            for conv, text, a, z in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), borders[:-1], borders[1:], strict=True)
        ]
        kinds = [pa.string() if isinstance(f.dataType, T.StringType) else pa.int64() for f in DIGEST]
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=DIGEST.names)


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id and the digest columns, read back from the output of format_conversations."""
    return formatted.select(*FORMATTED.names).mapInArrow(_digests, DIGEST)


def format_digests(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The same without a way to the JVM and back between: the output batches are made, then read back by the same worker."""
    return _over(rows, lambda batches: _digests(_formatted(batches, settings)), DIGEST)
