"""Redaction rules: regular expressions with tokens, applied as Spark expressions.

Two modes are offered. "chain" gives each rule the output of the one before; "last_match" gives each the original text
and keeps the output of the last rule that matched, as per-cell processing with an unrefreshed value does.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.text import let

CHAIN, LAST_MATCH = "chain", "last_match"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    pattern: str
    token: str
    needs: str = ""  # a string without which nothing matches: a cheap test before the pattern
    description: str = ""
    version: str = "v1"


#: Rule set v1, single backslashes.
RULES = (
    Rule("PHI_SSN", r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED_SSN]", "-", "US SSN pattern xxx-xx-xxxx"),
    Rule("PHI_SSN_DIGITS", r"\b\d{9}\b", "[REDACTED_SSN]", "", "9-digit SSN"),
    Rule("PHI_PHONE", r"\b\d{3}-\d{3}-\d{4}\b", "[REDACTED_PHONE]", "-", "Phone like 555-123-4567"),
    Rule("PHI_EMAIL", r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "[REDACTED_EMAIL]", "@", "Email addresses"),
    Rule("PHI_DATE_YYYYMMDD", r"\b\d{8}\b", "[REDACTED_DATE]", "", "Date like 20250215"),
    Rule("PHI_DATE_ISO", r"\b\d{4}-\d{2}-\d{2}\b", "[REDACTED_DATE]", "-", "Date like 2025-02-15"),
    Rule("PHI_ADDRESS_SIMPLE", r"\b\d+\s+[A-Za-z0-9\.\- ]+\b", "[REDACTED_ADDRESS]", "", "Simple street address (approx)"),
)
RULE_SET_VERSION = "v1"
#: Most specific first, so that the address rule does not eat parts of other identifiers.
SPECIFIC_FIRST = (
    "PHI_EMAIL", "PHI_PHONE", "PHI_SSN", "PHI_SSN_DIGITS", "PHI_DATE_ISO", "PHI_DATE_YYYYMMDD", "PHI_ADDRESS_SIMPLE",
)


def by_id(rules: Sequence[Rule] = RULES) -> list[Rule]:
    return sorted(rules, key=lambda r: r.rule_id)


def specific_first(rules: Sequence[Rule] = RULES) -> list[Rule]:
    """Rules in the default order of a chain; unknown ones come last, by id."""
    rank = {k: i for i, k in enumerate(SPECIFIC_FIRST)}
    return sorted(rules, key=lambda r: (rank.get(r.rule_id, len(rank)), r.rule_id))


def load(rows: DataFrame) -> list[Rule]:
    """Rules from rows (rule_id, pattern, replacement, and description and rule_version where there are such columns), by id.
    Rule tables are small and are read by the driver."""
    known = {r.rule_id: r for r in RULES}
    out = []
    for row in rows.orderBy("rule_id").collect():
        same, more = known.get(row["rule_id"]), row.asDict()
        needs = same.needs if same and same.pattern == row["pattern"] else ""
        out.append(Rule(row["rule_id"], row["pattern"], row["replacement"], needs, more.get("description") or "", more.get("rule_version") or RULE_SET_VERSION))
    return out


def rule_table(spark: SparkSession, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Rules as rows."""
    rows = [(r.rule_id, r.pattern, r.token, r.description, r.version) for r in rules]
    return spark.createDataFrame(rows, "rule_id string, pattern string, replacement string, description string, rule_version string")


def compiled(spark: SparkSession, rule: Rule) -> str:
    """The rule's pattern for the engine: ignoring case, with Unicode classes. One that the engine can't compile stands
    for its own text, case and all."""
    pattern = f"(?iU){rule.pattern}"
    java = spark.sparkContext._jvm.java.util.regex.Pattern
    try:
        java.compile(pattern)
    except Exception:  # the gateway's error for PatternSyntaxException
        return java.quote(rule.pattern)
    return pattern


def _token(rule: Rule) -> str:
    """The token as a literal replacement: $ and backslash stand for themselves."""
    return rule.token.replace("\\", "\\\\").replace("$", "\\$")


class RuleSet:
    """Rules in order, ready to be applied to columns."""

    def __init__(self, spark: SparkSession, rules: Sequence[Rule] | None = None, mode: str = CHAIN) -> None:
        if mode not in (CHAIN, LAST_MATCH):
            raise ValueError(f"no such mode: {mode}")
        ordered = list(rules) if rules is not None else specific_first() if mode == CHAIN else by_id()
        self.rules = [(r, compiled(spark, r)) for r in ordered]
        self.mode = mode
        self.version = "+".join(sorted({r.version for r in ordered})) or RULE_SET_VERSION

    def _matches(self, c: Column, rule: Rule, pattern: str) -> Column:
        found = c.rlike(pattern)
        return c.contains(rule.needs) & found if rule.needs else found

    def _replaced(self, c: Column, rule: Rule, pattern: str) -> Column:
        out = F.regexp_replace(c, F.lit(pattern), F.lit(_token(rule)))
        return F.when(c.contains(rule.needs), out).otherwise(c) if rule.needs else out

    def apply(self, c: Column) -> Column:
        """The redacted text; null and empty texts stay as they are."""
        out = c
        for rule, pattern in self.rules:
            if self.mode == CHAIN:
                out = self._replaced(out, rule, pattern)
            else:
                out = F.when(self._matches(c, rule, pattern), self._replaced(c, rule, pattern)).otherwise(out)
        return out

    def hits(self, c: Column) -> Column:
        """The ids of the rules that changed the text, in order: in a chain each is tested on the output before it."""
        return self.redact(c)["hits"]

    def redact(self, c: Column) -> Column:
        """A struct of the redacted text and its hits, every rule tested once, inside lambdas too. To use both fields, select the
        struct first."""
        state = F.struct(c.alias("text"), F.array().cast("array<string>").alias("hits"), c.alias("given"))
        for rule, pattern in self.rules:
            state = let(state, self._step(rule, pattern))
        return state

    def _step(self, rule: Rule, pattern: str) -> Callable[[Column], Column]:
        def step(s: Column) -> Column:
            source = s["text"] if self.mode == CHAIN else s["given"]
            new = F.regexp_replace(source, F.lit(pattern), F.lit(_token(rule)))
            hit = F.struct(new.alias("text"), F.concat(s["hits"], F.array(F.lit(rule.rule_id))).alias("hits"), s["given"].alias("given"))
            return F.when(F.coalesce(self._matches(source, rule, pattern), F.lit(False)), hit).otherwise(s)

        return step

    def flag(self, c: Column) -> Column:
        """Whether any rule matches."""
        return F.size(self.hits(c)) > 0


def match_counts(df: DataFrame, text: str, rules: RuleSet, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, rule_id, hits): how many texts each rule hits. One pass, added up before the shuffle."""
    hits = df.select(*keys, F.explode(rules.hits(F.col(text))).alias("rule_id"))
    return hits.groupBy(*keys, "rule_id").agg(F.count("*").alias("hits"))


def rules_applied(df: DataFrame, text: str, rules: RuleSet, keys: Sequence[str]) -> DataFrame:
    """The distinct rules applied by key."""
    return df.select(*keys, F.explode(rules.hits(F.col(text))).alias("rule_id")).distinct()
