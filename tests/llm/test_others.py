"""Language ID, URL filter, quality, chat, line rules and token counts."""

import hashlib
import math
import re
import unicodedata
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.llm import byte_bpe, chat, language_id, line_rules, quality_rules, queries, token_counts, url_filter
from tests.llm.conftest import prose

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


# Language ID


def test_languages_of_held_out_documents(spark, sf_dir):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = queries.op6_language_id(spark, sf_dir).collect()
    assert len(out) == len(docs) and all(r["held_out"] == (crc(r["doc_id"], 4) == 2) for r in out)
    held = [r for r in out if r["held_out"] and len(docs[r["doc_id"]]["text"]) > 40]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_odd_rows_and_empty_tables(spark, odd, none):
    rows = [(i, t, lang) for i in range(30) for lang, t in (("aa", "the cat and the dog " * 20), ("bb", "der hund und die katze " * 20))]
    rows += [(99, None, "aa"), (98, "text", None)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    dictionaries = language_id.learn(labelled)
    assert set(dictionaries) == {"aa", "bb"} and dictionaries == language_id.learn(labelled.repartition(5))
    out = language_id.identify(odd, dictionaries).collect()
    assert len(out) == odd.count()
    for r in out:
        if r["doc_id"] in (1, 2, 3):
            assert (r["lang_pred"], r["score"], r["accepted"]) == ("und", 0.0, False)
        elif r["doc_id"] is not None:
            assert r["lang_pred"] in ("aa", "bb")
    both = language_id.Classifier(dictionaries)
    assert both.predict("der hund und die katze")[0] == "bb" and both.predict("12 34")[0] == "und"
    assert language_id.identify(none, dictionaries).count() == 0
    assert language_id.learn(labelled.limit(0)) == {}
    assert {r["lang_pred"] for r in language_id.identify(odd, {}).collect()} == {"und"}
    same = language_id.Classifier({"x": dictionaries["aa"], "y": dictionaries["aa"]})
    assert same.predict("the cat")[0] == "x" and not same.predict("the cat")[3]


def test_every_language_is_learned(spark):
    """Three hundred labels, the rarest included; dictionaries share a bound."""
    own = lambda i: " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{w}" for w in ("omu", "tel", "ras", "kin", "dov", "lu"))
    rows = [(1000 * i + j, own(i) + " ", f"l{i:03}") for i in range(300) for j in range(3 if i % 2 else 1)]
    settings = language_id.Settings(all_dictionaries=300 * 60)
    dictionaries = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), settings)
    assert set(dictionaries) == {f"l{i:03}" for i in range(300)} and max(map(len, dictionaries.values())) <= 60
    c = language_id.Classifier(dictionaries)
    assert np.mean([c.predict(own(i))[0] == f"l{i:03}" for i in range(0, 300, 7)]) > 0.95


def plain_letters(text):
    out, gap = [], False
    for ch in (text or "").lower():
        if ch.isalnum() and not ch.isdecimal() and not re.match(r"\d", ch):
            if gap and out:
                out.append(" ")
            out.append(ch)
            gap = False
        else:
            gap = True
    return "".join(out)


def test_predictions_are_plain_compression(spark, sf_dir):
    """Every prediction of the query against the library's compressor called piece by piece, without the classifier."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    dictionaries = language_id.learn(docs.where(queries.fold(F.col("doc_id"), 4) != 2))
    s = language_id.Settings()

    def size(piece, data):
        how = language_id.zstandard.ZstdCompressionParameters.from_level(s.level, dict_size=len(data), source_size=s.piece_chars, min_match=s.min_match)
        d = language_id.zstandard.ZstdCompressionDict(data, dict_type=language_id.zstandard.DICT_TYPE_RAWCONTENT)
        frame = language_id.zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress(piece.encode())
        return len(frame)

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.op6_language_id(spark, sf_dir).collect():
        plain = plain_letters(texts[r["doc_id"]])
        if not plain:
            assert r["lang_pred"] == "und"
            continue
        if len(plain) > 12_000:
            continue  # slow without prepared dictionaries
        pieces = [plain[i : i + s.piece_chars] for i in range(0, len(plain), s.piece_chars)]
        sizes = {lang: sum(size(p, d) for p in pieces) for lang, d in dictionaries.items()}
        best = min(sizes.values())
        assert r["lang_pred"] in [lang for lang, n in sizes.items() if n - best <= 1 * len(pieces)]


def test_long_texts_count_whole():
    c = language_id.Classifier({"aa": b"the cat and the dog ran over a hill " * 50, "bb": b"der hund und die katze lief um den berg " * 50})
    assert c.predict("the cat and the dog " * 10 + "der hund und die katze lief " * 2000)[0] == "bb"


# URL filter

URLS = [
    ("http://a.net/x", "a.net", "/x", "net/", "block"), ("https://A.Example.NET/en/1?q", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://example.com/de/#f", "example.com", "/de/", "example.com/de/", "block"), ("http://x.org/fr/2", "x.org", "/fr/2", "org/fr/", "allow"),
    ("http://anet/x", "anet", "/x", None, None), ("http://a.net", "a.net", "", None, None), ("no scheme.net/", "", "", None, None),
    (None, "", "", None, None), ("", "", "", None, None), ("a://b://c.net/x", "b:", "//c.net/x", None, None), ("x://ÀB.net?y/z", "Àb.net", "", None, None),
    ("http://example.net/en", "example.net", "/en", "net/", "block"), ("http://" + "a" * 5000 + ".net/", "a" * 5000 + ".net", "/", "net/", "block"),
]


def test_hosts_paths_and_rules(spark):
    rows = [(i, u[0], "clash") for i, u in enumerate(URLS)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    out = url_filter.judge(pages, url_filter.train(), queries.URL_RULES).collect()
    assert len(out) == 2 * len(URLS)
    for r in out:
        url, host, path, rule, verdict = URLS[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if (host or path) and r["p_block"] >= 0.5 else "allow"))
        assert (r["host"], r["path"]) == url_filter.split_url(url)
    assert url_filter.judge(pages.limit(0), url_filter.train()).count() == 0


def name_of(url):
    host = url_filter.split_url(url)[0]
    return re.sub(r"^(www|m|blog)[.]", "", host).split(".")[0]


def test_held_out_names_are_judged_right():
    """Five folds by name: names of the fold are in no training URL, whatever their prefix, ending or path."""
    right, sure = [], []
    for fold in range(5):
        train = [(u, y) for u, y in url_filter.LABELLED if zlib.crc32(name_of(u).encode()) % 5 != fold]
        m = url_filter.train(train)
        for u, y in set(url_filter.LABELLED) - set(train):
            p = m.probability(*url_filter.split_url(u))
            right.append((p >= 0.5) == bool(y))
            sure.append(y * np.log(p) + (1 - y) * np.log(1 - p))
    assert len(right) == len(url_filter.LABELLED) > 300
    assert np.mean(right) > 0.93 and -np.mean(sure) < 0.5
    m = url_filter.train()
    assert np.mean([(m.probability(*url_filter.split_url(u)) >= 0.5) == bool(y) for u, y in url_filter.LABELLED]) > 0.99
    judge = lambda u: m.probability(*url_filter.split_url(u)) >= 0.5
    assert not judge("https://en.wikipedia.org/wiki/River") and judge("http://adult-webcams.example.com/xxx/1")


def test_probabilities_are_plain_regression(spark):
    """p_block of the query's operator against a sum over n-grams in plain Python, trained weights given."""
    m = url_filter.train()
    urls = [u for u, *_ in URLS] + [u for u, _ in url_filter.LABELLED[:40]]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in url_filter.judge(pages, m).collect():
        grams = set()
        for mark, part in (("h", r["host"]), ("p", r["path"])):
            data = f"^{part}$".encode() if part else b""
            grams |= {zlib.crc32(mark.encode() + data[i : i + n]) % 65536 for n in (3, 4, 5) for i in range(len(data) - n + 1)}
        z = m.bias + (sum(float(m.weights[g]) for g in grams) / math.sqrt(len(grams)) if grams else 0)
        assert r["p_block"] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-5)
        assert r["verdict"] == ("block" if grams and r["p_block"] >= 0.5 else "allow")


# Quality


def test_quality_of_held_out_documents(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # enough labels to learn from
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    out = {r["doc_id"]: r for r in queries.op8_quality_rules(spark, sf_dir).collect()}
    held = [d for d in labels if crc(d, 3) == 1]
    assert np.mean([out[d]["predicted"] == labels[d] for d in held]) > 0.95
    assert all(r["held_out"] == (crc(d, 3) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for d, r in out.items())


def test_compiled_rules_are_the_models(spark, odd, none):
    rng = np.random.default_rng(0)
    names = list(quality_rules.STATISTICS)
    x = rng.random((600, len(names)))
    y = ((x[:, 3] < 0.5) & (x[:, 9] > 0.2)).astype(float)
    model = quality_rules.fit(names, x, y)
    assert 0 < len(model.rules) < 120 and np.mean((model.predict(names, x) >= 0.5) == y) > 0.97
    rows = odd.select("doc_id", quality_rules.statistics(F.col("text")).alias("s"), quality_rules.score(F.col("text"), model).alias("p")).collect()
    want = model.predict(names, np.array([[r["s"][n] for n in names] for r in rows]))
    assert [r["p"] for r in rows] == pytest.approx(want.tolist())
    assert len(quality_rules.classify(odd, model).collect()) == odd.count()
    assert quality_rules.classify(none, model).count() == 0


def plain_statistics(text):
    t = text or ""
    words, lines, n = SPACE.findall(t), t.split("\n"), len(t)
    share = lambda chars: sum(c in chars for c in t) / max(n, 1)
    n_words = max(len(words), 1)
    return {
        "log_chars": math.log1p(n), "log_words": math.log1p(len(words)), "word_length": n / n_words, "symbols": share("#*$%&<>@~^=+_{}[]\\"),
        "bars": share("|"), "exclaims": share("!?"), "stops": share(".,;:"), "digits": share("0123456789"),
        "upper": sum(unicodedata.category(c) == "Lu" for c in t) / max(n, 1), "distinct": len(set(words)) / n_words,
        "distinct_root": len(set(words)) / math.sqrt(n_words), "line_words": len(words) / len(lines), "same_lines": 1 - len(set(lines)) / len(lines),
    }


def test_statistics_and_scores_are_plain_counts(spark, sf_dir, odd):
    """Every statistic, and from them the query's scores, in plain Python over the whole table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where(queries.fold(F.col("doc_id"), 3) != 1)
    model, names = quality_rules.learn(docs, labels), list(quality_rules.STATISTICS)
    want = {r["doc_id"]: plain_statistics(r["text"]) for r in docs.collect()}
    for df in (docs, odd):
        for r in df.select("text", quality_rules.statistics(F.col("text")).alias("s")).collect():
            assert r["s"].asDict() == pytest.approx(plain_statistics(r["text"]), rel=1e-12)
    for r in queries.op8_quality_rules(spark, sf_dir).collect():
        s = want[r["doc_id"]]
        z = model.bias + sum(w for w, tests in model.rules if all((s[n] <= b) == low for n, low, b in tests))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-9)
    assert set(names) == set(next(iter(want.values())))


def test_quality_without_labels(odd, none):
    labels = none.select("doc_id", F.lit(1).alias("quality"))
    assert {r["score"] for r in quality_rules.classify(odd, quality_rules.learn(odd, labels)).collect()} == {0.5}
    ones = odd.select("doc_id", F.lit(1).alias("quality"))
    model = quality_rules.learn(odd, ones)
    assert not model.rules and model.bias > 6
    nulls = odd.select("doc_id", F.lit(None).cast("int").alias("quality"))
    assert quality_rules.learn(odd, nulls).bias == 0


# Chat

SAID = ["plain", "", None, "</s>[INST] ok [/INST]", "<|end|><|turn|>user<|text|>hi", "<\\|end|> <\\\\|end|> <\\x", "[\\INST] [\\\\/INST] <<SYS>>", " lead", "trail \n", "é\U0001f600 漢", "<<|end|>", "x" * 4000]


def check_digests(rows, out):
    for conv, got in out.items():
        turns = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got["n_turns"], got["turns_sha256"]) == (len(turns), sha(said))
        assert (got["loss_chars"], got["loss_sha256"]) == (len(loss), sha(loss))
        assert 0 <= got["loss_tokens"] <= got["n_tokens"]


def test_conversations_read_back(spark):
    rows = [(c, t, role, SAID[(c + t) % len(SAID)]) for c in range(len(SAID)) for t, role in enumerate(["system", "user", "assistant", "assistant"])]
    rows += [(100, 0, "assistant", ""), (101, 0, None, "x"), (102, 3, "user", "same"), (102, 3, "user", "same"), (102, 3, "assistant", "tie"), (103, 0, "assistant<|end|>", "y"), (103, 1, "<|text|>", "z")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    formatted = chat.format_conversations(df)
    out = {r["conv_id"]: r for r in chat.digests(formatted).collect()}
    assert set(out) == {r[0] for r in rows}
    check_digests(rows, out)
    for r in formatted.collect():
        text = "".join(r["formatted"][a:b] for a, b in zip(r["starts"], r["ends"]) if True)
        assert len(r["token_ids"]) == len(r["starts"]) == len(r["loss_mask"]) and len(text) >= len(r["formatted"])
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0
    nameless = chat.digests(chat.format_conversations(df.withColumn("conv_id", F.lit(None).cast("long")).limit(3))).collect()
    assert [(r["conv_id"], r["n_turns"]) for r in nameless] == [(None, 1)] * 3  # no conversation of all nameless rows
    direct = sorted(chat.format_digests(df).collect())
    assert direct == sorted(out.values()) and chat.format_digests(df.limit(0)).count() == 0


def test_no_special_token_lies_in_a_text(spark):
    """Only the three markers are special, whatever the texts hold; runs of white space of any length are encoded."""
    said = [" ".join(chat.RESERVED), "".join(chat.RESERVED), " " * 2_000_000, "\n" * 1_200_000 + "x", "".join(chat.MARKERS) * 3]
    rows = [(i, t, role, x) for i, x in enumerate(said) for t, role in enumerate(["user", "assistant"])]
    formatted = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = {r["conv_id"]: r for r in chat.digests(formatted).collect()}
    check_digests(rows, out)
    for r in formatted.collect():
        ids = np.array(r["token_ids"])
        marks = [chat.MARKERS[i - 50256] for i in ids[ids >= 50256]]
        assert marks == [*chat.MARKERS] * 2
        assert not any(c in chat.escape(said[r["conv_id"]]) for c in chat.RESERVED + chat.MARKERS)
        assert chat.read_back(r["formatted"]) == [("user", said[r["conv_id"]]), ("assistant", said[r["conv_id"]])]


@given(st.lists(st.sampled_from(["<", "<s", ">", "\\", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/", "INST]", "<|end|>", "<|", "|>", "end", "x", "SYS>"]), max_size=14))
@settings(max_examples=400, deadline=None)
def test_every_escape_is_reversible(parts):
    text = "".join(parts)
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.MARKERS + chat.RESERVED)


def test_query_has_its_own_conversation(spark, sf_dir):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    said = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    out = {r["conv_id"]: r for r in queries.op5_chat(spark, sf_dir).collect()}
    assert set(out) == {r[0] for r in rows}
    check_digests(rows, out)


@pytest.mark.parametrize("text", [s for s in SAID if s is not None])
def test_escapes_are_reversible_and_leave_no_control_string(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in (chat.TURN, chat.TEXT, chat.END, "</s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_mask_by_binary_search():
    starts, ends = np.array([0, 2, 5, 5, 9]), np.array([2, 5, 6, 9, 12])
    assert chat.mask_tokens(starts, ends, [(2, 6), (9, 12)]).tolist() == [0, 1, 1, 0, 1]


# Line rules


def brute_lines(text):
    words = SPACE.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = {w for w in windows if windows.count(w) > 1}
    covered = {i + j for i, w in enumerate(windows) if w in many for j in range(5)}
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    n, rep = len(words), len(covered)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), rep, n < 10 or 100 * rep > 20 * n


REPEATS = ["a b c d e a b c d e", "a a a a a a", "a b c d e f a b c d e f g " * 3, "x\ny\nx\n \n \nx z", "a b c d e " * 40, "| a | b | c |", "á\u00a0b c\x0bd"]


def test_line_counts_are_plain_counts(spark, odd, none):
    texts = REPEATS + [prose(i, 200) + " " + prose(i, 30) for i in range(5)] + [None, ""]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    out = {r["doc_id"]: r for r in line_rules.clean_lines(df, keep=("doc_id",)).collect()}
    for i, t in enumerate(texts):
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_lines(t)
    assert len(line_rules.clean_lines(odd, keep=("doc_id", "_t")).collect()) == odd.count()
    assert line_rules.clean_lines(none, keep=("doc_id",)).count() == 0


def test_repeats_of_very_long_texts_are_exact(spark):
    """Two million words, all windows unlike but for one planted twice; and one word of megabytes, one line of megabytes."""
    words = [f"{i * 2654435761 % (1 << 32):x}" for i in range(1_000_000)]
    planted = words[:500_000] + ["here", "it", "is", "once", "more"] + words[500_000:] + ["here", "it", "is", "once", "more"]
    texts = [" ".join(planted), "x" * 5_000_000, "word " * 1_000_000, " " * 2_000_000 + "\n" * 500_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    out = {r["doc_id"]: r for r in line_rules.clean_lines(df, keep=("doc_id",)).drop("clean_text").collect()}
    assert [out[i]["n_words"] for i in range(4)] == [len(planted), 1, 1_000_000, 0]
    assert [out[i]["n_repeat_words"] for i in range(4)] == [10, 0, 1_000_000, 0]
    assert [out[i]["word_chars"] for i in range(4)] == [sum(map(len, planted)), 5_000_000, 4_000_000, 0]


def test_lines_that_go(spark):
    good = "This is a sentence of nine words or so."
    bad = ["BUY ALL OF THIS NOW!!", "### $$$ *** %%%", "Home | News | About | Contact", "All rights reserved.", "Click here to subscribe", "About us", "Mehr erfahren: jetzt gleich!", "It went on and on until...", "Política de privacidad."]
    df = spark.createDataFrame([(1, "\n".join([good, *bad, good + " Yes.", "Who? (He said “No.”)", "The blog into which it went."])), (2, "\n".join([good, *bad * 4])), (3, "\n".join([good] * 2))], "doc_id long, text string")
    out = {r["doc_id"]: r for r in line_rules.clean_lines(df, keep=("doc_id",)).collect()}
    assert out[1]["clean_text"] == f"{good}\n{good} Yes.\nWho? (He said “No.”)\nThe blog into which it went." and out[1]["n_lines"] == 13
    assert not out[2]["kept"] and out[3]["base_failed"]


def test_line_rules_run_no_python(spark, sf_dir):
    plan = queries.op9_line_rules(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


# Token counts


def brute_counts(encoder, fields):
    """Each token by its bytes, held against every span."""
    whole, spans, at = "\n".join(fields).encode(), [], 0
    for i, f in enumerate(fields):
        size = len(f.encode()) + (i + 1 < len(fields))
        spans.append((at, at + size))
        at += size
    at, rows = spans[-1][0], []
    for line in re.findall(rb"[^\n]*\n|[^\n]+", fields[-1].encode()):
        rows.append((at, at + len(line)))
        at += len(line)
    tokens, at = [], 0
    for i in encoder.encode_ordinary(whole.decode()):
        size = len(encoder.decode_single_token_bytes(i))
        tokens.append((at, at + size))
        at += size
    borders = {b for span in spans + rows for b in span}
    count = lambda span: sum(span[0] <= s < span[1] for s, _ in tokens)
    return len(tokens), [count(x) for x in spans], len(rows), sum(any(s < b < e for b in borders) for s, e in tokens), [count(x) for x in rows]


TOKEN_TEXTS = ["a b\nc d\n\n\ne", "x\n", "\n", "", "é\n漢\U0001f600 y\n\n  z", " \n \n", None, "one  two\r\n\r\nthree"]


@pytest.mark.parametrize("fields", [("text",), ("source", "lang", "text")])
def test_tokens_of_fields_and_sections(spark, sf_dir, odd, none, odd_rows, fields):
    e = byte_bpe.ByteBpe()
    rows = [(i, t, s, lang, "clash") for i, (t, s, lang) in enumerate(zip(TOKEN_TEXTS, ["src", None, "", "s\n\nt"] * 2, ["en", "", None, " "] * 2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_tokens string")
    docs = docs.unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 900").selectExpr("doc_id + 100 AS doc_id", "text", "source", "lang", "'' AS n_tokens"))
    want = {r["doc_id"]: brute_counts(e.model, [r[f] or "" for f in fields]) for r in docs.collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in token_counts.count_tokens(docs, fields=fields).collect()}
    assert got == want and len(want) > 50
    out = token_counts.count_tokens(odd, fields=("score", "text")).collect()
    assert len(out) == len(odd_rows)
    assert all(sum(r["field_tokens"]) == r["n_tokens"] and len(r["section_tokens"]) == r["n_sections"] for r in out)
    assert token_counts.count_tokens(none, fields=fields).count() == 0
    assert math.isclose(sum(token_counts.attribute(np.array([0, 3, 6]), np.array([0, 2, 6]))[0]), 2)
    assert token_counts.attribute(np.array([0, 3, 6]), np.array([0, 2, 4, 6]))[1] == 2


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 1_500_000 + "x", "y" + "\u3000" * 1_000_000, "x" * 5_000_000, "word " * 1_000_000, "a\t \n" * 700_000])
def test_very_long_runs_are_encoded_whole(text):
    e = byte_bpe.ByteBpe()
    borders = e.borders(e.encode(text))
    assert borders[-1] == len(text.encode()) == sum(e.lengths[e.encode(text)])
    n, by_field, _, sections = token_counts.count_record(e, ["s", text])
    assert n == sum(by_field) and by_field[1] == sections.sum() > 0


@given(st.lists(st.sampled_from(["a", "b ", " ", "   ", "\n", "\n\n\n", "\t", ".", "1", "\xa0", "\u3000", "é", "'s", "\x1c", "\x85", "\u200b", "漢", "     "]), max_size=20))
@settings(max_examples=400, deadline=None)
def test_cut_runs_change_no_id(parts):
    text = "".join(parts)
    assert byte_bpe.shared().model.encode_ordinary(text) == SHORT_RUNS.encode(text).tolist()


SHORT_RUNS = byte_bpe.ByteBpe(long_run=3)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_labelled_urls_are_of_no_given_table(spark, sf_dir, sf):
    pages = spark.read.parquet(f"{sf_dir}/../{sf}/pages.parquet").select("url").distinct().collect()
    given = [url_filter.split_url(r["url"]) for r in pages]
    labelled = [url_filter.split_url(u) for u, _ in url_filter.LABELLED]
    assert not {h for h, _ in labelled} & {h for h, _ in given}
    assert not {p for _, p in labelled if len(p) > 1} & {p for _, p in given}
