import re

import pytest
from pyspark.sql import functions as F

from strandline.operators.rules import LAST_MATCH, RULES, Rule, RuleSet, by_id, compiled, load, specific_first


def texts(spark, rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")


def run(spark, rules, rows):
    out = texts(spark, rows).select("i", rules.apply(F.col("t")).alias("o"), rules.hits(F.col("t")).alias("h"))
    return [(r["o"], r["h"]) for r in out.orderBy("i").collect()]


SAMPLES = [
    "ssn 123-45-6789 phone 555-123-4567", "12 a.b@x.org", "2025-02-15 visit", "221B Baker Street", "id 123456789 on 20250215",
    "é123-45-6789", "１２３-45-6789", "", None, "nothing", "MAIL A.B@X.ORG",
]


def python_chain(text):
    hits = []
    for r in specific_first():
        text, n = re.subn(r.pattern, r.token, text, flags=re.I)
        hits += [r.rule_id] * (n > 0)
    return text, hits


def python_last(text):
    out, hits = text, []
    for r in by_id():
        new, n = re.subn(r.pattern, r.token, text, flags=re.I)
        if n:
            out = new
            hits.append(r.rule_id)
    return out, hits


def test_chain_is_pythons(spark):
    got = run(spark, RuleSet(spark), SAMPLES)
    for text, (out, hits) in zip(SAMPLES, got, strict=True):
        assert (out, hits) == ((None, []) if text is None else python_chain(text)), text


def test_last_match_is_pythons(spark):
    got = run(spark, RuleSet(spark, mode=LAST_MATCH), SAMPLES)
    for text, (out, hits) in zip(SAMPLES, got, strict=True):
        assert (out, hits) == ((None, []) if text is None else python_last(text)), text


@pytest.mark.parametrize("mode", ["chain", LAST_MATCH])
def test_redact_in_lambdas_is_apply_and_hits(spark, mode):
    rules = RuleSet(spark, mode=mode)
    whole = F.transform(F.array("t"), lambda x: rules.redact(x))[0]
    got = texts(spark, SAMPLES).select("i", whole.alias("r")).orderBy("i").collect()
    assert [(r["r"]["text"], r["r"]["hits"]) for r in got] == run(spark, rules, SAMPLES)


def test_chain_in_id_order_lets_the_address_rule_eat_others(spark):
    assert run(spark, RuleSet(spark, by_id()), ["ssn 123-45-6789 phone 555-123-4567"])[0][0].startswith("ssn 123-45-[REDACTED_ADDRESS]")


def test_no_pattern_matches_what_the_chain_leaves(spark):
    out = [o for o, _ in run(spark, RuleSet(spark), SAMPLES) if o]
    assert run(spark, RuleSet(spark), out) == [(o, []) for o in out]


def test_doubled_backslashes_match_nothing_and_bad_patterns_stand_for_themselves(spark):
    doubled = [Rule(r.rule_id, r.pattern.replace("\\", "\\\\"), r.token) for r in RULES]
    assert [o for o, _ in run(spark, RuleSet(spark, doubled), SAMPLES[:5])] == SAMPLES[:5]
    bad = Rule("BAD", "a(b", "[X]")
    assert compiled(spark, bad) == r"\Qa(b\E"
    assert [o for o, _ in run(spark, RuleSet(spark, [bad]), ["xa(by", "xA(By"])] == ["x[X]y", "xA(By"]


def test_tokens_are_literal(spark):
    assert run(spark, RuleSet(spark, [Rule("D", r"\d+", r"$1\2")]), ["a12b"])[0][0] == r"a$1\2b"


def test_rules_load_in_order_of_id(spark):
    rows = spark.createDataFrame([(r.rule_id, r.pattern, r.token) for r in RULES], "rule_id string, pattern string, replacement string")
    assert load(rows) == by_id()


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        RuleSet(spark, mode="best")


def test_every_document_is_redacted_as_python_does(spark, sf_dir):
    from strandline.queries import QUERIES

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["scrub_chain"](spark, sf_dir).collect():
        assert (r["redacted"], r["rules"]) == python_chain(docs[r["doc_id"]])


def test_queries_cover_documents_of_every_language(spark, tmp_path):
    from strandline.queries import QUERIES

    rows = [(i, t, lang, "web" if i % 3 else "mail") for i, (t, lang) in enumerate((t, lang) for lang in ("en", "de", "fr", None) for t in SAMPLES)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    counts, ssn = {}, by_id()[[r.rule_id for r in by_id()].index("PHI_SSN")]
    for _, text, _, source in rows:
        for rule in python_last(text)[1] if text else []:
            counts[source, rule] = counts.get((source, rule), 0) + 1
    own = lambda rows: [r for r in rows if r["source"] != "literal"]
    assert {(r["source"], r["rule_id"]): r["hits"] for r in own(run("scrub_counts"))} == counts
    assert sorted((r["source"], r["rule_id"]) for r in own(run("rules_by_source"))) == sorted(counts)
    assert {r["id"]: r["redacted"] for r in run("scrub_last_match") if r["id"] >= 0} == {i: text and python_last(text)[0] for i, text, *_ in rows}
    want = {i: (None, 0) if text is None else re.subn(ssn.pattern, ssn.token, text, flags=re.I) for i, text, *_ in rows}
    assert {r["id"]: (r["redacted"], r["hit"]) for r in run("scrub_ssn") if r["id"] >= 0} == {i: (t, n > 0) for i, (t, n) in want.items()}
