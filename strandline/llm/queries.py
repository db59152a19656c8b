"""The queries of the training-data operators, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import chat, decontaminate, language_id, line_rules, lm_score, near_dup, quality_rules, subword, token_counts, url_filter
from strandline.llm.common import fold, table


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = lm_score.score_documents(docs, docs.where(fold(F.col("doc_id"), 7) != 2))
    held_out = (fold(F.col("doc_id"), 7) == 2).alias("held_out")
    return out.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op2_subword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword.encode_texts(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return decontaminate.matches(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.format_digests(rows.unionByName(own))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    dictionaries = language_id.learn(docs.where(fold(F.col("doc_id"), 4) != 2))
    out = language_id.identify(docs.select("doc_id", "text"), dictionaries)
    held_out = (fold(F.col("doc_id"), 4) == 2).alias("held_out")
    return out.select("doc_id", held_out, "lang_pred", "score", "margin", "accepted")


#: The rules of the URL query.
URL_RULES = (
    url_filter.Rule("net/", url_filter.BLOCK),
    url_filter.Rule("example.net/en/", url_filter.ALLOW),
    url_filter.Rule("example.com/de/", url_filter.BLOCK),
    url_filter.Rule("org/fr/", url_filter.ALLOW),
)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    return url_filter.judge(pages, url_filter.train(), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "p_block")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").where(fold(F.col("doc_id"), 3) != 1)
    model = quality_rules.learn(docs, labels)
    held_out = (fold(F.col("doc_id"), 3) == 1).alias("held_out")
    return quality_rules.classify(docs, model).select("doc_id", held_out, "score", "predicted")


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = line_rules.clean_lines(docs, keep=("doc_id",))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_lines_kept", "clean_chars", F.sha2("clean_text", 256).alias("clean_sha256"),
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "text")
    return token_counts.count_tokens(docs, fields=("source", "lang", "text"))


# Parts of the operators' results that SQL can express on whole tables, each got through its operator.


def lm_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_lm_score(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")


def subword_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of what the ids of every document decode to."""
    encoded = op2_subword(spark, sf_dir)
    return encoded.select("doc_id", F.sha2(subword.decoder_column()("ids"), 256).alias("decoded_sha256"), (F.col("n_ids") > 0).alias("some"))


def leaks_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_decontaminate(spark, sf_dir).where("edits = 0").select("doc_id", "item_id")


def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_chat(spark, sf_dir).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op7_url_filter(spark, sf_dir)
    return out.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict"))


def token_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op10_token_counts(spark, sf_dir)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    by_text = F.element_at("field_tokens", -1)
    sums = (total(F.col("field_tokens")) == F.col("n_tokens")) & (total(F.col("section_tokens")) == by_text)
    return out.select("doc_id", "n_sections", sums.alias("adds_up"))


_WORDS_SQL = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '')"""
#: crc32 of the id as text: each byte is mixed in, then shifted out in eight steps (the steps are the -1s).
_CRC_SQL = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
        lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x)
        ELSE xor(c >> 1, (c & 1) * 3988292384) END))"""
_LM_TOKENS_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, list_append({_WORDS_SQL}, '') AS ws, {_CRC_SQL} % 7 = 2 AS held_out FROM documents),
t AS (SELECT k, doc_id, held_out, unnest(ws) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w)
SELECT doc_id, held_out, CAST(count(*) AS BIGINT) AS n_tokens, CAST(count(c) AS BIGINT) AS n_known, CAST((SELECT sum(c) FROM c) AS BIGINT) AS train_tokens
FROM t LEFT JOIN c USING (w) GROUP BY k, doc_id, held_out
"""
_NORMAL_SQL = r"trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[!-/:-@\[-`{-~]', '', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')"
_LEAKS_SQL = f"""
WITH d AS (SELECT doc_id, {_NORMAL_SQL} AS t FROM documents), b AS (SELECT item_id, {_NORMAL_SQL} AS t FROM benchmark)
SELECT doc_id, item_id FROM d JOIN b ON contains(d.t, b.t) AND b.t <> ''
"""
_CHAT_SQL = """
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss FROM r GROUP BY conv_id)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256 FROM g
"""


def _rule_sql(rule: url_filter.Rule) -> str:
    return f"((host = '{rule.host}' OR ends_with(host, '.{rule.host}')) AND starts_with(path, '{rule.path}'))"


_LONGEST_FIRST = sorted(URL_RULES, key=lambda r: -len(r.pattern))
_URL_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {_rule_sql(r)} THEN '{r.pattern}'" for r in _LONGEST_FIRST)} END AS rule,
  CASE {" ".join(f"WHEN {_rule_sql(r)} THEN '{r.verdict}'" for r in _LONGEST_FIRST)} END AS rule_verdict FROM p
"""
_SECTIONS_SQL = r"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+')) AS BIGINT) AS n_sections, true AS adds_up FROM documents"

_OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
r(id, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.y FROM r JOIN l ON l.x = r.v),
c AS (SELECT id, min(v) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n USING (doc_id)
"""

_PHRASE, _ENDED = (x.replace("'", "''") for x in (line_rules.PHRASE, line_rules.ENDED))
_R = line_rules.LineRules()
_OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT k, i, array_to_string(ws[i:i + 4], ' ') AS win FROM w, unnest(range(1, greatest(len(ws) - 3, 1))) AS u(i) WHERE len(ws) >= 5),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, win) AS c FROM g) WHERE c > 1),
p AS (SELECT k, count(DISTINCT i + j) AS n_rep FROM r, unnest(range(0, 5)) AS v(j) GROUP BY k),
l AS (SELECT k, unnest(ls) AS line, generate_subscripts(ls, 1) AS place FROM w),
m AS (SELECT k, place, line, regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g') AS dense,
      list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS lw FROM l),
q AS (SELECT k, place, line, length(dense) AS n, len(lw) AS nw, length(regexp_replace(dense, '[^\p{{L}}]+', '', 'g')) AS nl,
      length(regexp_replace(dense, '[^\p{{Lu}}]+', '', 'g')) AS nu, length(dense) - length(regexp_replace(dense, '[#*$%&|<>]', '', 'g')) AS ns,
      len(list_filter(lw, lambda x: x IN ('|', '»', '›', '>', '•', '·', '/'))) AS nm, 
      regexp_matches(lower(line), '{_PHRASE}') AS boil, regexp_matches(line, '{_ENDED}') AS ended, regexp_matches(line, '{line_rules.TEASER}') AS teaser FROM m),
s AS (SELECT k, count(*) AS n_lines, count(*) FILTER (NOT bad) AS n_kept, coalesce(sum(n) FILTER (NOT bad), 0) AS chars,
      string_agg(line, chr(10) ORDER BY place) FILTER (NOT bad) AS clean FROM (SELECT k, place, line, n, (100 * ns > {_R.symbol_share} * n) OR (nw >= {_R.upper_words} AND 100 * nu > {_R.upper_share} * nl AND nl > 0)
        OR (nm >= {_R.menu_words} AND 100 * nm > {_R.menu_share} * nw) OR (nw <= {_R.boilerplate_words} AND boil) OR (nw < {_R.open_words} AND NOT ended)
        OR (nw <= {_R.teaser_words} AND teaser) AS bad FROM q) GROUP BY k),
o AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
      CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_rep, 0) AS BIGINT) AS n_repeat_words,
      CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_kept, 0) AS BIGINT) AS n_lines_kept,
      CAST(coalesce(chars, 0) AS BIGINT) AS clean_chars, sha256(coalesce(clean, '')) AS clean_sha256 FROM w LEFT JOIN p USING (k) LEFT JOIN s USING (k)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM o)
SELECT *, NOT base_failed AND NOT (100 * (word_chars - clean_chars) > {_R.lost_share} * word_chars) AS kept FROM b
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": op1_lm_score,
    "op2_subword": op2_subword,
    "op3_near_dup": op3_near_dup,
    "op4_decontaminate": op4_decontaminate,
    "op5_chat": op5_chat,
    "op6_language_id": op6_language_id,
    "op7_url_filter": op7_url_filter,
    "op8_quality_rules": op8_quality_rules,
    "op9_line_rules": op9_line_rules,
    "op10_token_counts": op10_token_counts,
    "lm_tokens": lm_tokens,
    "subword_decoded": subword_decoded,
    "leaks_verbatim": leaks_verbatim,
    "chat_turns": chat_turns,
    "url_rules": url_rules,
    "token_sections": token_sections,
}
ORACLE_SQL: dict[str, str] = {
    "op3_near_dup": _OP3_SQL,
    "op9_line_rules": _OP9_SQL,
    "lm_tokens": _LM_TOKENS_SQL,
    "subword_decoded": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256, coalesce(text, '') <> '' AS some FROM documents",
    "leaks_verbatim": _LEAKS_SQL,
    "chat_turns": _CHAT_SQL,
    "url_rules": _URL_SQL,
    "token_sections": _SECTIONS_SQL,
}
