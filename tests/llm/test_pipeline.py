from pyspark.sql import functions as F

import corpus_pipeline as cp
from strandline.llm import decontaminate as dc
from strandline.llm import quality_rules, queries
from tests.llm.conftest import prose
from tests.llm.test_near_dup import brute
from tests.llm.test_others import plain_statistics


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    items = [dc.normalise(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for k, (name, stage) in enumerate(cp.STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if k == len(cp.STAGES) - 1 else cp.settle(docs)
        after = {r["doc_id"]: r for r in docs.collect()}
        gone = set(before) - set(after)
        assert set(after) <= set(before)
        if name != "subword":
            assert docs.columns == columns and all(after[d] == before[d] for d in after)
        if name == "language_id":
            assert gone == {r["doc_id"] for r in queries.op6_language_id(spark, sf_dir).where("NOT accepted").collect()}
            assert all(len(before[d]["text"] or "") < 60 for d in gone)
        elif name == "quality_rules":
            known = spark.read.parquet(f"{sf_dir}/labels.parquet").where(queries.fold(F.col("doc_id"), 3) != 1)
            rows = spark.createDataFrame([(r["doc_id"], r["text"]) for r in before.values()], "doc_id long, text string")
            model = quality_rules.learn(rows, known)
            stats = {d: plain_statistics(r["text"]) for d, r in before.items()}
            total = lambda s: model.bias + sum(w for w, tests in model.rules if all((s[n] <= b) == low for n, low, b in tests))
            assert gone == {d for d, s in stats.items() if total(s) < 0}
            wrong = [d for d in labels if d in before and (d in gone) != (labels[d] == 0)]
            assert len(wrong) < 0.1 * len(labels)
        elif name == "near_dup":
            want = brute([(d, r["text"]) for d, r in before.items()], 80)
            assert set(after) == {d for d, (_, c) in want.items() if c == d}
        elif name == "decontaminate":
            assert {d for d in before if any(t in dc.normalise(before[d]["text"]) for t in items)} <= gone
        else:
            assert set(after) == set(before) and all(r["round_trip"] and r["n_ids"] == len(r["ids"]) for r in after.values())
        before = after
    ran = cp.run(spark, sf_dir)
    assert sorted(r["doc_id"] for r in ran.collect()) == sorted(before)


def test_odd_rows_and_empty_tables(spark, odd, none, sf_dir):
    for docs in (odd, none):
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns and out.count() <= docs.count()
    last = cp.encoded(spark, odd, sf_dir)
    assert last.columns == [*odd.columns, "ids_", "n_ids_", "round_trip"] and last.count() == odd.count()


def test_repeated_ids_leave_one_row(spark, sf_dir):
    rows = [(1, prose(1, 50)), (1, prose(1, 50)), (2, prose(1, 50)), (3, prose(2, 50)), (None, prose(3, 50)), (None, prose(4, 50)), (5, prose(6, 50)), (5, prose(7, 50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    out = cp.near_duplicates(spark, docs, sf_dir).collect()
    assert sorted((r["doc_id"] or 0) for r in out) == [0, 0, 1, 3, 5, 5] and all(r["kept"] == "clash" for r in out)
