"""Token counts attributed to the fields and sections of documents.

A document is its fields, one after the other, each but the last followed by a line end. It is encoded whole and once.
Byte-level tokens spell the text exactly, so token spans are running sums of token lengths; the spans of fields and
sections are running sums too, and the sorted lists are joined by binary search. A token that crosses a border belongs to
the field or section that holds its first byte, so the counts add up to the whole.

Sections are the lines of the last field, each up to and with its line end. Other spans can be given to attribute() as
sorted byte borders.

Defined results. A null field is empty. Without any character in any field there are no tokens; a null or empty last
field has no sections. A field or section that only holds the rest of a token counts 0. Very long texts, runs of white
space and words of megabytes included, are encoded whole. Repeated rows get equal counts; an empty table gives an empty
result; columns that are not named as fields play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm import byte_bpe
from strandline.llm.common import slices


@dataclass(frozen=True)
class Settings:
    ranks: str = byte_bpe.RANKS
    pattern: str = byte_bpe.PATTERN


def lines(data: bytes) -> np.ndarray:
    """Borders of the sections of a text: 0, the place after each line end, and the text's length."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    if len(data) and (not len(ends) or ends[-1] != len(data)):
        ends = np.append(ends, len(data))
    return np.concatenate([[0], ends]).astype(np.int64)


def attribute(token_borders: np.ndarray, section_borders: np.ndarray) -> tuple[np.ndarray, int]:
    """Tokens by section, each counted where its first byte lies, and how many tokens cross a border."""
    starts, ends = token_borders[:-1], token_borders[1:]
    at = np.searchsorted(starts, section_borders, "left")
    crossing = np.searchsorted(section_borders, ends, "left") - np.searchsorted(section_borders, starts, "right")
    return np.diff(at), int((crossing > 0).sum())


COUNTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("field_tokens", T.ArrayType(T.LongType())),
        T.StructField("n_sections", T.LongType()),
        T.StructField("n_crossing", T.LongType()),
        T.StructField("section_tokens", T.ArrayType(T.IntegerType())),
    ]
)


def count_record(encoder: byte_bpe.ByteBpe, fields: list[str]) -> tuple[int, list[int], int, np.ndarray]:
    """Tokens of a record, its tokens by field, how many cross a border of a field or section, and tokens by section."""
    whole = "\n".join(fields)
    borders = encoder.borders(encoder.encode(whole))
    sizes = [len(f.encode()) + 1 for f in fields]
    sizes[-1] -= 1
    of_fields = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    sections = lines(fields[-1].encode()) + of_fields[-2]
    by_field, _ = attribute(borders, of_fields)
    _, crossing = attribute(borders, np.union1d(of_fields, sections))
    return len(borders) - 1, by_field.tolist(), crossing, attribute(borders, sections)[0]


def count_tokens(docs: DataFrame, settings: Settings = Settings(), *, fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """For each row of docs (doc_id and the fields): its tokens, tokens by field and by section, and border-crossing ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe.ByteBpe(settings.ranks, settings.pattern)
        for batch in slices(batches):
            columns = [batch.column(i + 1).to_pylist() for i in range(len(fields))]
            found = [count_record(encoder, [v or "" for v in row]) for row in zip(*columns, strict=True)]
            n_tokens, by_field, crossing, sections = zip(*found, strict=True) if found else ((), (), (), ())
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sections])]).astype(np.int32)
            flat = pa.array(np.concatenate([*sections, np.zeros(0, np.int64)]).astype(np.int32))
            arrays = [batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(by_field, pa.list_(pa.int64()))]
            arrays += [pa.array(np.diff(ends), pa.int64()), pa.array(crossing, pa.int64()), pa.ListArray.from_arrays(ends, flat)]
            yield pa.RecordBatch.from_arrays(arrays, names=COUNTS.names)

    return docs.select("doc_id", *[F.col(f).cast("string") for f in fields]).mapInArrow(run, COUNTS)
