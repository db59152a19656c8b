import random

import numpy as np
import pytest
import sentencepiece

from strandline.llm import subword as sw

MODEL = sw.Settings().model


@pytest.fixture(scope="module")
def encoder():
    return sw.Encoder(sw.Model.read(MODEL))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


ODD = [
    "", " ", "Hello  world", "  a\n\nb ", "a\tb", "é漢\U0001f600", "▁x y", "</s> hi", "a\x00b", "a\r\nb　c\xa0d", "aaaaaaaaaaaa bbbbbb", "====---- ....  ....",
    "1234567890 12 3", "привет мир", "x" * 5000, " " * 300 + "y",
]


def random_texts(n, letters, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 50))) for _ in range(n)]


def test_ids_and_texts_are_the_librarys(encoder, library):
    texts = ODD + random_texts(1500, "abcdeorntsi  .,\n'éß漢", 1) + random_texts(300, "ab ", 2)
    ours, theirs = encoder.encode(texts), library.encode(texts)
    assert [i.tolist() for i in ours] == theirs
    assert [encoder.decode(i) for i in ours] == library.decode(theirs)


def test_round_trip_over_the_table(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {r["doc_id"]: r for r in sw.encode_texts(docs).collect()}
    for r in docs.collect():
        assert out[r["doc_id"]]["ids"] == library.encode(r["text"] or "")
        assert out[r["doc_id"]]["round_trip"]


def test_odd_rows_and_empty_tables(odd, none, odd_rows):
    out = sw.encode_texts(odd, keep=("doc_id", "text", "ids")).toDF("doc_id", "text", "old", "ids", "n_ids", "round_trip")
    rows = out.collect()
    assert len(rows) == len(odd_rows) and all(r["round_trip"] and r["n_ids"] == len(r["ids"]) and r["old"] == "clash" for r in rows)
    assert all(not r["ids"] for r in rows if not r["text"])
    texts = out.select("text", sw.decoder_column()("ids").alias("back")).collect()
    assert all(r["back"] == (r["text"] or "") for r in texts)
    assert sw.encode_texts(none).count() == 0


def brute_unigram(model, word):
    """The best score of all cuts of a word."""
    ids = {model.pieces[i]: i for i in model.plain}
    worst = min(model.scores[i] for i in model.plain) - 10
    best = [0.0] + [-np.inf] * len(word)
    for i in range(1, len(word) + 1):
        for j in range(i):
            piece = word[j:i]
            score = model.scores[ids[piece]] if piece in ids else worst if i - j == 1 else None
            if score is not None and best[j] + score > best[i]:
                best[i] = best[j] + score
    return best[-1]


def test_unigram_is_the_best_cut():
    rng = random.Random(3)
    pieces = ["<unk>", *sorted({sw.MARK, "a", "b", "c", *["".join(rng.choice("abc") for _ in range(rng.randint(2, 4))) for _ in range(30)], sw.MARK + "a", sw.MARK + "bc"})]
    model = sw.Model(pieces, [0.0] + [-rng.random() * 8 - 1 for _ in pieces[1:]], "unigram", plain=frozenset(range(1, len(pieces))))
    e = sw.Encoder(model)
    for text in random_texts(200, "abc ", 4) + ["abxab", "xx"]:
        ids = e.encode([text])[0].tolist()
        got = sum(model.scores[i] for i in ids if i)
        if "x" not in text:
            assert got == pytest.approx(sum(brute_unigram(model, w) for w in e.mark(text)))
            assert e.decode(np.array(ids)) == text
        else:
            assert 0 in ids and not any(a == b == 0 for a, b in zip(ids, ids[1:]))


def test_kept_state_is_bounded(library):
    e = sw.Encoder(sw.Model.read(MODEL), sw.Settings(kept_words=5, kept_pairs=50))
    texts = random_texts(50, "abcde ", 5)
    for t in texts * 2:
        assert e.encode([t])[0].tolist() == library.encode(t)
