import random
import re

import numpy as np
import pytest

from strandline.llm import near_dup as nd
from tests.llm.conftest import prose

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = SPACE.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute(rows, percent=85):
    """doc_id to (size, component), by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    at = list(range(len(rows)))

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if sets[i] and 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
                at[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return {d: (len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(rows)}


def edited(text, rng, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"q{rng.randrange(10**6)}"
    return " ".join(words)


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


SETTINGS = {"default": nd.Settings(), "split": nd.Settings(split_rows=2, filter_bits=4), "four fifths": nd.FOUR_FIFTHS}


@pytest.mark.parametrize("name", SETTINGS)
def test_groups_are_those_of_all_pairs(spark, name):
    """Copies, chains of edits and many copies around the threshold, with unlike texts between."""
    rng = random.Random(0)
    texts = []
    for seed in range(6):
        base = prose(100 + seed, 150)
        texts += [base, base.upper(), base + " tail"]
        texts += [edited(base, rng, rng.randint(0, 6)) for _ in range(25)]
        step = base
        for _ in range(6):
            step = edited(step, rng, 2)
            texts.append(step)
    texts += [prose(200 + i, rng.randint(1, 80)) for i in range(40)]
    ids = rng.sample(range(10**6), len(texts))
    rows = list(zip(ids, texts, strict=True))
    settings = SETTINGS[name]
    want = brute(rows, settings.percent)
    assert len({c for _, c in want.values()}) < len(rows) - 50
    assert found(nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), settings)) == want


def test_a_large_bucket_is_split_and_whole(spark):
    """Many texts that share a frame and are near, but not near enough, with a few links hidden among them."""
    rng = random.Random(5)
    base = prose(77, 220).split()
    texts = [" ".join(w if rng.random() < 0.965 else f"z{rng.randrange(10**6)}" for w in base) for _ in range(120)]
    texts += [edited(t, rng, 2) for t in texts[::15]]
    rows = list(enumerate(texts, 1))
    assert found(nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), nd.Settings(split_rows=7))) == brute(rows)


def test_what_was_made_is_freed(spark, tmp_path):
    from strandline.llm import common

    docs = spark.createDataFrame([(i, prose(i % 7, 40)) for i in range(30)], "doc_id long, text string")
    kept = common.settled_path(spark)
    with common.Temporary(spark) as made:
        out = common.settle(nd.near_duplicates(docs), kept)
    assert made.paths and made.held and not common.Temporary._open
    assert not any(spark.sparkContext._jvm.java.io.File(p.removeprefix("file://")).exists() for p in made.paths)
    assert not any(df.is_cached for df in made.held) and out.where("kept").count() == 7


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = nd.near_duplicates(docs)
    assert found(out) == brute([tuple(r) for r in docs.collect()])
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out.collect())


def test_odd_rows_and_empty_tables(odd, none, odd_rows):
    rows = nd.near_duplicates(odd).collect()
    assert len(rows) == len(odd_rows)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for i in (1, 2, 3):
        assert (by[i][0]["n_shingles"], by[i][0]["component_id"], by[i][0]["kept"]) == (0, i, True)
    assert by[4][0]["n_shingles"] == 1 and by[9][0]["n_shingles"] == 1
    assert by[5][0]["component_id"] == by[6][0]["component_id"] == 5 and not by[6][0]["kept"]
    assert len(by[7]) == 2 and all(r["component_id"] == 7 and r["kept"] for r in by[7]) and by[10][0]["component_id"] == 7
    assert sorted(r["n_shingles"] for r in by[None]) == [0, 56] and all(r["component_id"] is None and r["kept"] for r in by[None])
    assert nd.near_duplicates(none).count() == 0


def test_whitespace_and_case_follow_the_contract():
    h = nd.Hasher()
    a, b, c, d = h.sets(["A b\x0bc d e f", "a B C\nd\te\x0cf", "a b c d e\x1cf", "É b c d e f"])
    assert a.tolist() == b.tolist() and len(a) == 2
    assert len(c) == 1 and d.tolist() != a.tolist()  # 0x1C parts no words; É stays
    one, two = h.sets(["a b", "a b a b"])
    assert len(one) == len(two) == 1 and one != two


@pytest.mark.parametrize("settings, shared", [(nd.Settings(), 400), (nd.FOUR_FIFTHS, 387)])
def test_sketch_bounds_lose_nothing(settings, shared):
    """Pairs at the threshold, far more than would show one lost in a thousand."""
    rng = np.random.default_rng(0)
    h = nd.Hasher(settings)
    s = h.settings
    pool = nd.scramble(np.arange(1, 400_000, dtype=np.uint64))
    sets = []
    for _ in range(300):
        x = rng.choice(pool, 470, replace=False)
        own = 435 - shared  # of 435 elements each
        sets += [np.sort(x[:435]), np.sort(np.concatenate([x[:shared], x[435 : 435 + own]]))]  # 0.851 and 0.801
    coarse, fine = h.digests(sets)[2], h.fine_sketches(sets)
    bits = lambda k: np.bitwise_count(k[::2] ^ k[1::2]).sum(axis=1)
    assert bits(coarse).max() <= s.sketch_bits and bits(fine).max() <= s.fine_bits


@pytest.mark.parametrize("links", [[], [(1, 2)], [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8)], [(i, i + 1) for i in range(40)] + [(100, 50), (50, 100), (7, 7)]])
def test_components(spark, links):
    got = {r["id"]: r["component"] for r in nd.components(spark.createDataFrame(links, "a long, b long")).collect()}
    least = {v: v for e in links for v in e}
    for _ in links:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert got == {v: c for v, c in least.items() if v != c}
