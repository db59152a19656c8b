"""Language identification by compression.

Each language has a raw-content zstandard dictionary cut from labelled texts. A text is compressed with every dictionary
in turn and the language of the smallest result is chosen; a narrow margin over the runner-up is a rejection. Texts are
lower-cased, runs of non-letters become one space, and pieces of a few kilobytes are compressed one by one so that
the dictionary counts throughout a long text, not only at its start.

Defined results. A null text, or one without a letter, is "und" with score 0 and is not accepted. Equal sizes go to the
language more frequent in training (then by name), with a score of at most a half and no acceptance. Very long texts are read whole.
Repeated rows get equal results; an empty table gives an empty result. Training rows with null language or text are not
learned from; with no training rows at all every text is "und". Every label is learned, however rare: where there are many,
their dictionaries get smaller, so that a worker's memory stays bounded (half a megabyte or so for each label).
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import thinned

UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")
PREDICTION = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("margin", T.DoubleType()),
        T.StructField("accepted", T.BooleanType()),
    ]
)


@dataclass(frozen=True)
class Settings:
    dictionary_bytes: int = 112 * 1024  # of each language's dictionary
    sample_docs: int = 400  # labelled texts read for each language: the bound of the training sample
    sample_bytes: int = 4 << 20  # of them used for each language: those of the first texts that reach it
    all_dictionaries: int = 16 << 20  # bytes of all dictionaries; with many languages each gets an equal share
    piece_chars: int = 4096  # compressed at once
    level: int = 6
    min_match: int = 3  # words are short, and so are the matches that tell languages apart
    min_margin: float = 0.01  # runner-up's size over the smallest, less one, below which a text is rejected


def letters(text: str | None) -> str:
    """The text as it is compressed: lower case, letters and single spaces."""
    return _OTHER.sub(" ", (text or "").lower()).strip()


def learn(labelled: DataFrame, settings: Settings = Settings()) -> dict[str, bytes]:
    """Dictionaries from rows (doc_id, text, lang), the most frequent language first: from a bounded sample of texts for
    each language, the same for the same rows."""
    spark = labelled.sparkSession
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # one small row for each label
    if not counts:
        return {}
    share = min(settings.dictionary_bytes, settings.all_dictionaries // len(counts))
    totals = F.broadcast(spark.createDataFrame([(r["lang"], r["count"]) for r in counts], "lang string, _total long"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    picked = (
        known.join(totals, "lang")
        .where(thinned(F.col("doc_id"), settings.sample_docs, F.col("_total")))
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= settings.sample_docs)
        .select("lang", "_rank", "text")
        .orderBy("lang", "_rank")
    )
    found: dict[str, bytes] = {}
    for lang, rows in groupby(picked.toLocalIterator(), key=lambda r: r["lang"]):  # one language at a time
        texts, size = [], 0
        for row in rows:
            if size < settings.sample_bytes:
                texts.append(letters(row["text"]))
                size += len(texts[-1])
        found[lang] = _fill(texts, share)
    return {r["lang"]: found[r["lang"]] for r in counts if found.get(r["lang"])}


def _fill(texts: list[str], size: int) -> bytes:
    """Words of the texts, in shuffled order: what matches is then words and parts of words, never a whole passage
    that happens to be quoted in a text of another language."""
    words = sorted(w for t in texts for w in t.split())
    random.Random(0).shuffle(words)
    return " ".join(words).encode()[:size]


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], settings: Settings = Settings()) -> None:
        self.settings = settings
        self.langs = list(dictionaries)
        self.compressors = []
        for lang in self.langs:
            data = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(
                settings.level, dict_size=len(dictionaries[lang]), source_size=settings.piece_chars, min_match=settings.min_match,
                write_checksum=False, write_content_size=False, write_dict_id=False,
            )
            data.precompute_compress(compression_params=how)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=data, compression_params=how))

    def sizes(self, text: str | None) -> list[int] | None:
        """The compressed size under each language, or None if there is nothing to compress."""
        plain = letters(text)
        if not self.langs or not any(map(str.isalpha, plain)):  # superscripts and the like are no letters
            return None
        step = self.settings.piece_chars
        pieces = [plain[i : i + step].encode() for i in range(0, len(plain), step)]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.compressors]

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        sizes = self.sizes(text)
        if sizes is None:
            return UNKNOWN, 0.0, 0.0, False
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = sizes[:best] + sizes[best + 1 :]
        margin = (min(rest) - sizes[best]) / sizes[best] if rest else 1.0
        # Code lengths as probabilities under equal priors: each byte saved is eight bits.
        score = 1.0 / (1.0 + sum(2.0 ** (-8 * min(s - sizes[best], 100)) for s in rest))
        return self.langs[best], score, margin, margin >= self.settings.min_margin


def predictor(dictionaries: dict[str, bytes], settings: Settings = Settings()):
    """A column function of a text: a struct of lang_pred, score, margin and accepted."""

    @F.pandas_udf(PREDICTION)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Classifier(dictionaries, settings)
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=PREDICTION.names)

    return predict


def identify(docs: DataFrame, dictionaries: dict[str, bytes], settings: Settings = Settings(), *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep with lang_pred, score, margin and accepted of each text."""
    return docs.select(*keep, predictor(dictionaries, settings)("text").alias("_p")).select(*keep, "_p.*")
