import random

import pytest
from pyspark.sql import functions as F

from strandline.llm import decontaminate as dc
from tests.llm.conftest import prose


def least_edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


LETTERS = "abcdefghijklmnopqrstuvwxyzжя漢"


def changed(text, rng, n):
    data = list(text)
    for _ in range(n):
        at, kind = rng.randrange(len(data)), rng.randrange(3)
        if kind == 0:
            data[at] = rng.choice(LETTERS)
        elif kind == 1 and len(data) > 1:
            del data[at]
        else:
            data.insert(at, rng.choice(LETTERS))
    return "".join(data)


def invented(seed, n):
    """n characters of words in several scripts, in normal form."""
    rng = random.Random(seed)
    text = " ".join("".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 7))) for _ in range(n))
    return text[: n - 1] + "x" if n else ""


@pytest.mark.parametrize("held", [1 << 22, 7])
def test_matches_are_those_of_full_alignment(held):
    """Items of every length, a tenth of it in edits, whatever the script; held in parts as well."""
    rng = random.Random(0)
    lengths = [*range(1, 60), *range(60, 200, 9)]
    index = dc.Index([(n, invented(n, n)) for n in lengths], dc.Settings(held_pairs=held))
    assert [len(t) for _, t in index.items] == lengths and index.budget.tolist() == [n // 10 for n in lengths]
    others = [invented(1000 + i, 200) for i in range(10)]
    for k in [*range(len(lengths)), *[rng.randrange(len(lengths)) for _ in range(100)]]:
        budget, pattern = int(index.budget[k]), index.items[k][1]
        planted = pattern if not budget else changed(pattern, rng, rng.randint(0, budget + 2))
        text = rng.choice(others) + " " + planted + " " + rng.choice(others)
        found = {}
        for t, item, edits, _ in index.search(["", text, rng.choice(others)]):
            found[t, item] = min(edits, found.get((t, item), 10**6))
        true = least_edits(pattern, text) if budget else 0
        assert found.get((1, k)) == (true if true <= budget else None)


def test_short_items_stand_between_word_borders():
    index = dc.Index([(1, "cat"), (2, "a"), (3, "The capital of France"), (4, "да"), (5, "?!"), (6, None)], dc.Settings(chunk_chars=4))
    hits = lambda text: sorted({(index.items[k][0], e) for _, k, e, _ in index.search([dc.normalise(text)])})
    assert hits("so the capital of France is") == [(3, 0)]
    assert hits("the capitol of Franze") == [(3, 2)] and not hits("teh capitol of Franze")
    assert hits("concatenate") == [] and hits("The cat!") == [(1, 0)] and hits("cat") == [(1, 0)] and hits("a") == [(2, 0)]
    assert hits("x" * 300 + " cat " + "y" * 300) == [(1, 0)] and not hits(("x" * 100 + "cat" + "y" * 100) * 3)
    assert hits("ну да") == [(4, 0)] and not hits("дар")
    assert [p for _, _, _, p in index.search(["z" * 40 + " cat"])] == [41]


def test_the_table_has_the_planted_passages(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = [(r["item_id"], dc.normalise(r["text"])) for r in items.collect()]
    want = {(d["doc_id"], i) for d in docs.collect() for i, t in plain if t in dc.normalise(d["text"])}
    got = {(r["doc_id"], r["item_id"]): r for r in dc.matches(docs, items).collect()}
    assert want and {k for k, r in got.items() if r["edits"] == 0} == want
    small = dc.Settings(block_bytes=600, chunk_chars=1000)
    assert len(dc.blocks(items, small)) > 3
    assert {(r["doc_id"], r["item_id"]): tuple(r) for r in dc.matches(docs, items, small).collect()} == {k: tuple(r) for k, r in got.items()}
    hit = docs.where(dc.contaminated(items)(F.col("text"))).select("doc_id").collect()
    assert sorted(r[0] for r in hit) == sorted({d for d, _ in got})


def test_odd_rows_and_empty_tables(spark, odd, none):
    long = odd.where("doc_id = 5").first()["text"]
    rows = [(1, None), (2, ""), (3, "tiny"), (4, long[70_000:70_300]), (4, long[70_000:70_300]), (None, odd.where("doc_id = 10").first()["text"][:80]), (6, long[-200:])]
    items = spark.createDataFrame([(i, t, "clash") for i, t in rows], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"], r["edits"]) for r in dc.matches(odd, items).collect()}
    assert {(5, 4, 0), (6, 4, 0), (5, 6, 0), (6, 6, 0), (7, None, 0), (10, None, 0)} <= got
    assert not {d for d, _, _ in got} & {1, 2, 3, 4, 8, 9} and not {i for _, i, _ in got} & {1, 2, 3}
    assert dc.matches(odd, items.limit(0)).count() == dc.matches(none, items).count() == 0
    assert odd.where(dc.contaminated(items.limit(0))(F.col("text"))).count() == 0
    very_long = dc.Index([(1, "short words only here for the match of it all")], dc.Settings(chunk_chars=64))
    text = dc.normalise(prose(9, 400) + " short words only here for the match of it all " + prose(10, 400))
    assert {(t, k, e) for t, k, e, _ in very_long.search([text])} == {(0, 0, 0)}


@pytest.mark.parametrize("text", ["Some Words, here!", "some words here", "  some\n words \x0b here "])
def test_normal_form(text):
    assert dc.normalise(text) == "some words here"
