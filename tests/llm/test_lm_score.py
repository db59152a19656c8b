import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import lm_score as lm
from strandline.llm import queries


def base_of(texts, training):
    counts = Counter()
    for t in training:
        counts.update(lm.plain(t).split())
        counts[b""] += 1
    n, v = sum(counts.values()), len(counts)
    out = []
    for t in texts:
        words = [*lm.plain(t).split(), b""]
        out.append((len(words), sum(counts[w] > 0 for w in words), n, sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in words)))
    return out


@pytest.mark.parametrize("head", [200_000, 40])
def test_base_is_plain_counting(spark, sf_dir, head):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    training = docs.where(queries.fold(F.col("doc_id"), 7) != 2)
    got = {r["doc_id"]: r for r in lm.score_documents(docs, training, lm.Settings(head_words=head, sample_docs=10)).collect()}
    rows = docs.collect()
    want = base_of([r["text"] for r in rows], [r["text"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2])
    for r, (tokens, known, n, base) in zip(rows, want, strict=True):
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (tokens, known, n)
        assert g["base_score"] == pytest.approx(base, rel=1e-9)
        assert g["score"] < 0


def test_odd_rows_and_empty_tables(odd, none):
    out = lm.score_documents(odd, odd.where("doc_id < 7"), lm.Settings(sample_docs=1)).collect()
    assert len(out) == odd.count()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["n_tokens"] == by[2][0]["n_tokens"] == by[3][0]["n_tokens"] == 1
    assert by[7][0]["score"] == by[7][1]["score"] and by[5][0]["score"] == by[6][0]["score"]
    assert by[2][0]["score"] == by[1][0]["score"] > by[3][0]["score"]
    assert lm.score_documents(none, none).count() == 0
    untrained = {r["doc_id"]: r for r in lm.score_documents(odd.where("doc_id < 5"), none).collect()}
    assert untrained[4]["base_score"] == 0 and untrained[4]["n_known"] == 0 and untrained[4]["score"] < 0


def whole(text):
    return next(lm.parts_of(text, max(len(text), 1)))


def mixer(training, contexts=(1, 2), seed=0, **settings):
    s = lm.Settings(contexts=contexts, **settings)
    counts = np.bincount(np.frombuffer(b"".join(training), np.uint8), minlength=257)
    counts[lm.END] = len(training)
    code, bits = lm.Code(counts), 12
    tables = [np.zeros((2, 1 << bits), np.uint32) for _ in contexts]
    for text in training:
        for table, keys in zip(tables, lm.bit_keys([whole(text)], code, s), strict=True):
            np.add.at(table, (keys & 1, keys >> np.uint32(32 - bits)), 1)
    weights = np.random.default_rng(seed).random((len(contexts), 8)) * 0.8
    return lm.Mixer(code, [lm.vote_of(w)[lm.codes(t)] for w, t in zip(weights, tables)], s)


def test_code_is_complete():
    """A prefix code without waste: the bits spell every symbol, so the model is a probability of texts."""
    m = mixer([b"abab ba", b"aab", b"b a"])
    assert sum(2.0 ** -float(n) for n in m.code.length) == pytest.approx(1)
    assert m.nats([b"", b"a", b"ab a"]).min() > 0


def plain_nats(m, text):
    """Bit by bit, in plain Python."""
    s, code, kinds = m.settings, m.code, len(m.tables)
    contexts = lm.Chunk([whole(text)], s).contexts
    factor, change, cost, bit, block = [1.0] * kinds, [0.0] * kinds, 0.0, 0, (0, 1)
    for place, symbol in enumerate([*text, lm.END]):
        for at in range(code.first[symbol], code.first[symbol + 1]):
            if bit and bit % s.row == 0 and bit // s.row == block[1]:
                share = s.rate / np.sqrt(block[1] - block[0])
                factor = [min(3, max(0.25, f + share * c)) for f, c in zip(factor, change)]
                change, block = [0.0] * kinds, (block[1], block[1] + max(1, block[1] // s.growth))
            salt = code.salt[at : at + 1]
            found = [int(t[lm._slots(c[lm.LEAD + place : lm.LEAD + place + 1], np.array([1]), salt, b)[0]]) for t, c, b in zip(m.tables, contexts, m.bits)]
            votes = [v / 8 * (1 if code.bit[at] else -1) for v in found]
            z = sum(f * v for f, v in zip(factor, votes))
            cost += np.log1p(np.exp(-z))
            change = [c + v / (1 + np.exp(z)) for c, v in zip(change, votes)]
            bit += 1
    return cost


TEXTS = [b"abab ba", b"aab", b"b a" * 40, b"", b"zz \xc3\xa9", b"ab ba " * 300]


def test_vectors_are_bit_by_bit_mixing():
    m = mixer([b"abab ba" * 20, b"aab", b"b a"], contexts=(1, 2, lm.WORD), row=16, growth=3, rate=0.05)
    assert m.nats(TEXTS) == pytest.approx([plain_nats(m, t) for t in TEXTS], rel=1e-4)
    assert m.nats(TEXTS) == pytest.approx([m.nats([t])[0] for t in TEXTS], rel=1e-6)


@pytest.mark.parametrize("limit", [1, 7, 64, 1000])
def test_pieces_carry_contexts_and_multipliers_on(limit):
    """A long text costs the same piece by piece, its words longer than a piece included."""
    m = mixer([b"abab ba" * 20, b"aab" * 30, b"b a"], contexts=(1, 3, lm.WORD), row=16, growth=3, rate=0.05)
    texts = [*TEXTS, b"abaab" * 40 + b" " + b"b" * 90]
    whole = m.nats(texts)
    m.settings = lm.Settings(contexts=(1, 3, lm.WORD), row=16, growth=3, rate=0.05, chunk_bytes=limit)
    assert [m.long_nats(t) for t in texts] == pytest.approx(whole.tolist(), rel=1e-5)
    assert -m.score(texts) * np.log(10) == pytest.approx(whole, rel=1e-5)


def test_words_are_cut_between_words():
    for text in (b"a bc  def\ng", b"", b"x" * 50, b" " * 30, b"ab " * 20):
        for limit in (1, 3, 8):
            pieces = lm.word_pieces(text, limit)
            assert b"".join(pieces) == text and sum((p.split() for p in pieces), []) == text.split()


def test_codes_keep_confidence_and_odds():
    pairs = np.array([[0, 1, 0, 1, 3, 20, 0, 400], [0, 0, 2, 2, 3, 0, 61, 0]], float)
    found = lm.codes(pairs)
    assert (found >> 5).tolist() == [0, 1, 2, 3, 4, 5, 6, 6] and found[0] == lm.EMPTY
    assert lm.ODDS[found & 31] == pytest.approx(np.log(pairs[1] + 0.4) - np.log(pairs[0] + 0.4), abs=0.5)


def test_gate_bits_are_spread_and_know_their_own_counts():
    s = lm.Settings(contexts=(2, lm.WORD), sample_bits=50, count_bytes=40)
    text = b"some words and some more words " * 20
    code = lm.Code(np.bincount(np.frombuffer(text, np.uint8), minlength=257))
    chosen, own = lm._gate_bits(text, code, [9, 10], s)
    keys = list(lm.bit_keys([whole(text)], code, s))
    pick = np.arange(0, len(keys[0]), -(-len(keys[0]) // 50))
    assert chosen.shape[1] == len(pick) <= 50 and (chosen[0] == keys[0][pick] & 1).all()
    for k, bits in enumerate((9, 10)):
        slots = keys[k] >> np.uint32(32 - bits)
        assert (chosen[1 + k] == slots[pick]).all()
        for b in (0, 1):
            assert own[k, b].tolist() == [int(((slots == x) & (keys[k] & 1 == b)).sum()) for x in slots[pick]]


def test_scores_are_plain_counting_and_mixing(spark, sf_dir, monkeypatch):
    """The whole way of the query's operator, tables and all, against dictionaries; only the fitted weights are taken over."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("n_chars < 600 OR doc_id % 9 = 0")
    kept = {}
    fit = lm.fit_weights
    monkeypatch.setattr(lm, "fit_weights", lambda *a: kept.setdefault("w", fit(*a)))
    monkeypatch.setattr(lm, "gate_sample", lambda *a, old=lm.gate_sample: kept.setdefault("g", (old(*a), a[1], a[2]))[0])
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(docs, docs.where("doc_id % 5 <> 0")).collect()}
    s, (sample, code, bits) = lm.Settings(), kept["g"]
    texts = {r["doc_id"]: lm.plain(r["text"]) for r in docs.collect()}
    pairs = [{} for _ in bits]
    for i, text in texts.items():
        if i % 5:
            for k, keys in enumerate(lm.bit_keys([whole(text)], code, s)):
                for key in keys.tolist():
                    pairs[k].setdefault(key >> 32 - bits[k], [0, 0])[key & 1] += 1
    tables = [np.full(1 << b, lm.EMPTY, np.uint8) for b in bits]
    for table, found in zip(tables, pairs):
        for slot, pair in found.items():
            table[slot] = lm.codes(np.array(pair, float)[:, None])[0]
    votes = [np.rint(np.clip(kept["w"][k, np.arange(256) >> 5] * lm.ODDS[np.arange(256) & 31] * 8, -127, 127))[t].astype(np.int8) for k, t in enumerate(tables)]
    m = lm.Mixer(code, votes, s)
    some = sorted(texts, key=lambda i: (len(texts[i]), i))[:: max(1, len(texts) // 12)][:12]
    for i in some:
        if len(texts[i]) < 3000:
            assert got[i] == pytest.approx(-plain_nats(m, texts[i]) / np.log(10), rel=1e-4)
    assert {i: got[i] for i in texts} == pytest.approx({i: float(x) for i, x in zip(texts, m.score(list(texts.values())))}, rel=1e-6)
    for k, r in ((k, r) for r in sample[:5] for k in range(len(bits))):
        slots, own = np.frombuffer(r["slots"], np.uint32).reshape(len(bits), -1)[k], np.frombuffer(r["own"], np.uint32).reshape(len(bits), 2, -1)[k]
        assert all(pairs[k][int(x)][b] >= own[b][j] for j, x in enumerate(slots) for b in (0, 1))


def test_scores_do_not_depend_on_the_layout_of_files(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    run = lambda d: {r["doc_id"]: (r["score"], r["base_score"]) for r in lm.score_documents(d, d.where("doc_id % 7 <> 2")).collect()}
    one, other = run(docs.coalesce(1)), run(docs.orderBy(F.xxhash64("text")).repartition(5))
    assert all(one[i] == pytest.approx(other[i], rel=1e-9) for i in one) and len(one) == docs.count()


def test_contexts_do_not_cross_texts():
    s = lm.Settings()
    alone, after = lm.Chunk([whole(b"hello you")], s), lm.Chunk([whole(b"something else"), whole(b"hello you")], s)
    for a, b in zip(alone.contexts, after.contexts, strict=True):
        assert a[alone.start[0] : alone.stop[0]].tolist() == b[after.start[1] : after.stop[1]].tolist()


def test_learning_helps(spark, sf_dir):
    """Held-out texts cost far less than the five bits or so of a byte without contexts."""
    out = queries.op1_lm_score(spark, sf_dir).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum(F.col("score") / F.col("bits_per_byte"))).first()
    assert -out[0] * np.log2(10) / (-out[2] * np.log2(10)) < 3.0


def test_tally_by_hash_is_counting():
    texts = [b"a b a", b"", b"  ", b"b\x0bc\x1cd\na"]
    t = lm.Tally()
    t.add(texts[:2])
    t.add(texts[2:])
    batch = t.take()
    want = Counter(w for x in texts for w in x.split())
    want[b""] = 4
    assert dict(zip(batch.column("key").to_pylist(), batch.column("n").to_pylist(), strict=True)) == want
    assert t.symbols[ord("a")] == 3 and t.symbols[10] == 1 and t.symbols[lm.END] == 4


def test_head_look_up_with_taken_places():
    texts = [f"w{i}".encode() for i in range(300)]
    hashes = lm.WordHasher().split([b" ".join(texts)]).hashes
    head = lm.Head(hashes, 1000 - np.arange(300), 7, 10_000, 6)  # 64 places a table for 300 words
    assert len(head.tables) > 4
    words = lm.WordHasher().split([b"w1 w2 w299 other", b"", b"other w5 more"])
    base, known, rare, others = head.look_up(words)
    log = lambda n: np.log10((n + 1) / 10_000)
    assert base == pytest.approx([log(999) + log(998) + log(701) + log(7), log(7), log(995) + log(7)])
    assert known.tolist() == [4, 1, 2] and others.tolist() == [1, 0, 2]
    assert rare.tolist() == words.hashes[[3, 4, 6]].tolist()
    assert not lm.Head(hashes[:0], np.zeros(0), 0, 1, 6).look_up(words)[0].any()


def test_tables_grow_with_the_contexts(spark):
    """Counts are those of plain counting, in parts too, and no number of contexts outgrows the tables."""
    s = lm.Settings(held_counts=2_000, count_bytes=4_000)
    texts = [" ".join(f"{i * 7919 + j:x}" for j in range(60)) for i in range(100)]
    plain = [t.encode() for t in texts]
    symbols = np.bincount(np.frombuffer(b"".join(plain), np.uint8), minlength=257)
    symbols[lm.END] = len(plain)
    code, docs = lm.Code(symbols), spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [Counter(keys.tolist()) for keys in lm.bit_keys([whole(t) for t in plain], code, s)]
    for parts in (0, 3):
        rows, got, slots = lm.count_contexts(docs, code, parts, s).collect(), [Counter() for _ in want], [0] * len(want)
        for r in rows:
            k, part = r["part"] >> parts, r["part"] & (1 << parts) - 1
            slots[k] += r["slots"]
            for x in lm._unpack(r["data"], 32 + parts, lm.zstandard.ZstdDecompressor()).tolist():
                got[k][part << 32 - parts | x >> 32 + parts] += x & (1 << 32 + parts) - 1
        assert got == want
        assert slots == [len({key >> 1 for key in w}) for w in want]
        bits = [12, 13, 14]
        counts = spark.createDataFrame(rows, lm.COUNTS)
        for r in lm.quantised(counts, parts, bits).collect():
            k, part = r["part"] >> parts, r["part"] & (1 << parts) - 1
            pairs = np.zeros((2, 1 << bits[k]))
            for key, n in want[k].items():
                pairs[key & 1, key >> 32 - bits[k]] += n
            size = (1 << bits[k]) >> parts
            slots = np.arange(0, 1 << bits[k], 37)
            if not part:
                wanted = [np.arange(0, 1 << b, 37) for b in bits]
                at = lm.counts_at(counts, parts, bits, wanted)
                every = np.zeros((2, 1 << bits[k]))
                for key, n in want[k].items():
                    every[key & 1, key >> 32 - bits[k]] += n
                assert (at[k] == every[:, slots]).all()
            found = lm.zstandard.ZstdDecompressor().decompress(r["data"])
            assert found == lm.codes(pairs)[part * size : (part + 1) * size].tobytes()
    for n in (1, 5_000, 1 << 22, 50_000_000, 1 << 29):
        assert 2 * n <= 1 << lm.table_bits(n, 0) <= max(1024, 4 * n)


def test_sums_are_made_in_place_block_by_block():
    rng = np.random.default_rng(0)
    for shift, high in ((32, 1 << 32), (35, 1 << 29)):
        packed = [(rng.integers(high - 40, high, n).astype(np.uint64) << np.uint64(shift)) | rng.integers(1, 9, n).astype(np.uint64) for n in (0, 1, 50, 300)]
        want = Counter()
        for x in np.concatenate(packed).tolist():
            want[x >> shift] += x & (1 << shift) - 1
        for block in (1, 3, 64, 1000):
            found = packed.copy()
            sums = lm._add_up(found, shift, block).tolist()
            assert not found and sums == sorted(key << shift | n for key, n in want.items())
    assert not len(lm._add_up([], 32))


def test_adding_up_holds_the_numbers_once():
    import tracemalloc

    packed = [np.sort(np.random.default_rng(i).integers(0, 1 << 62, 1 << 20).astype(np.uint64)) for i in range(4)]
    whole = sum(x.nbytes for x in packed)
    tracemalloc.start()
    lm._add_up(packed, 32)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1.5 * whole  # beside the numbers that came; six times before


def test_each_bit_is_left_out_of_its_slot():
    rng = np.random.default_rng(0)
    pairs = np.concatenate([rng.integers(0, 4, (2, 300)), rng.integers(0, 500, (2, 40))], axis=1).astype(float)
    want = np.zeros((2, 256))
    for zeros, ones in pairs.T.tolist():
        for _ in range(int(zeros)):
            want[0, lm.codes(np.array([[zeros - 1], [ones]]))[0]] += 1
        for _ in range(int(ones)):
            want[1, lm.codes(np.array([[zeros], [ones - 1]]))[0]] += 1
    assert (lm.left_out(pairs) == want).all() and want.sum() == pairs.sum()
    assert not lm.left_out(np.zeros((2, 5))).any()


def test_gates_come_from_all_training_documents(spark, sf_dir, monkeypatch):
    """Weights are fitted on each bit of each training document, whatever the layout, and no sample is drawn."""
    kept, fit = [], lm.fit_weights
    monkeypatch.setattr(lm, "fit_weights", lambda seen, sample, *a: kept.append((seen, sample)) or fit(seen, sample, *a))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("n_chars < 600")
    for rows in (docs, docs.repartition(5, "text")):
        lm.score_documents(rows, rows)
    texts = [lm.plain(r["text"]) for r in docs.collect()]
    symbols = np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=257)
    symbols[lm.END] = len(texts)
    n_bits = int((lm.Code(symbols).length * symbols).sum())
    for seen, sample in kept:
        assert not sample and (seen.sum(axis=(1, 2)) == n_bits).all()
    assert (kept[0][0] == kept[1][0]).all()


def test_weights_are_of_least_cost():
    rng = np.random.default_rng(0)
    seen = rng.integers(0, 1000, (2, 2, 256)).astype(float)
    at = np.arange(256)
    seen[:, 1] = seen[:, 0] * np.exp(0.7 * lm.ODDS[at & 31])  # log-odds are seven tenths of what the codes say
    found = lm.single_weights(seen)
    assert found[:, 1:] == pytest.approx(0.7, abs=0.02)
    assert lm.single_weights(np.zeros((3, 2, 256))) == pytest.approx(1)


def test_pairs_are_counted_before_they_are_spelled():
    """The counts of all bits, by sorting no more than one number for each symbol."""
    s = lm.Settings()
    texts = [b"some words and some more words " * 9, b"", b"\xff\xc3\xa9 zz", b"a"]
    code = lm.Code(np.bincount(np.frombuffer(b"".join(texts[:2]), np.uint8), minlength=257))
    chunk = lm.Chunk([whole(t) for t in texts], s)
    for context, keys in zip(chunk.contexts, lm.bit_keys([whole(t) for t in texts], code, s), strict=True):
        found = lm.bit_counts(context[chunk.coded], chunk.symbol[chunk.coded], code).tolist()
        assert found == [key << 32 | n for key, n in sorted(Counter(keys.tolist()).items())]
