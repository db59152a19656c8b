"""Redaction of records: whole columns by declaration, free text by rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import blank, fields, let, lines, with_replaced
from strandline.operators.metadata import Declared, position
from strandline.operators.rules import RuleSet
from strandline.operators.validate import json_kind

NAME, DATE, GENERIC = "[REDACTED_NAME]", "[REDACTED_DATE]", "[REDACTED]"
#: The ids under which whole-column redactions are recorded.
COLUMN_RULES = {NAME: "PHI_COLUMN_REDACT_NAME", DATE: "PHI_COLUMN_REDACT_DATE", GENERIC: "PHI_COLUMN_REDACT_GENERIC"}


def table_token(column: Declared) -> str:
    """The token of a delimited column: by its name, dates by name or declared type."""
    name = column.column_name.lower()
    if "name" in name:
        return NAME
    return DATE if "dob" in name or "date" in column.data_type.lower() else GENERIC


def object_token(column: Declared) -> str:
    """The token of an object's key: by its name alone."""
    name = column.column_name.lower()
    if "name" in name:
        return NAME
    return DATE if "dob" in name or "date" in name else GENERIC


def field_token(column: Declared) -> str | None:
    """The token of a message field, by exact position or name; None where the rules decide."""
    name, at = column.column_name.upper(), position(column.column_name)
    if "NAME" in name or at == 5:
        return NAME
    return DATE if "DOB" in name or at == 7 else None


def scrub_table(rows: DataFrame, columns: Sequence[Declared], rules: RuleSet, *, scrub_extra: bool = False, keep: Sequence[str] = ("batch_id", "row_no")) -> DataFrame:
    """Rows of text columns, redacted, with hits: the ids of the rules applied in each row, once for each cell.

    Declared PHI columns hold their token in every row, empty cells too; other declared columns pass the rules; columns
    that are not declared pass through unless scrub_extra is set."""
    by_name = {c.column_name: c for c in columns}
    staged, out, hits = [], [], []
    for i, name in enumerate(rows.columns):
        cell, column = F.col(f"`{name}`"), by_name.get(name)
        if name in keep or (column is None and not scrub_extra):
            staged.append(cell)
            out.append(cell)
        elif column is not None and column.is_phi:
            token = table_token(column)
            out.append(F.lit(token).alias(name))
            hits.append(F.array(F.lit(COLUMN_RULES[token])))
        else:
            staged.append(rules.redact(cell).alias(f"_cell{i}"))
            out.append(F.col(f"_cell{i}.text").alias(name))
            hits.append(F.col(f"_cell{i}.hits"))
    found = F.concat(*hits) if hits else F.array().cast("array<string>")
    return rows.select(*staged).select(*out, found.alias("hits"))


def scrub_objects(rows: DataFrame, columns: Sequence[Declared], rules: RuleSet) -> DataFrame:
    """Rows (batch_id, row_no, line) of JSON objects: with line redacted, and hits.

    Declared PHI keys that are present hold their token whatever their value; string values of all other keys, declared
    or not, pass the rules; other values stay. Lines that are no object stay as they are."""
    phi = {c.column_name: object_token(c) for c in columns if c.is_phi}
    none = F.array().cast("array<string>")

    def entry(e: Column) -> Column:
        k, v = e["key"], e["value"]
        token = F.lit(None).cast("string")
        for name, t in phi.items():
            token = F.when(k == name, t).otherwise(token)
        text = F.when(json_kind(v) == "string", F.try_variant_get(v, "$", "string"))
        return let(F.struct(token.alias("token"), rules.redact(text).alias("r")), lambda x: redacted(k, v, x["token"], x["r"]))

    def redacted(k: Column, v: Column, token: Column, r: Column) -> Column:
        hits = F.lit(None).cast("array<string>")
        for t, rule in COLUMN_RULES.items():
            hits = F.when(token == t, F.array(F.lit(rule))).otherwise(hits)
        new = F.coalesce(token, r["text"])
        # Both kinds of value become one-element arrays as variants, the element is then taken out again.
        value = F.when(new.isNotNull(), F.to_variant_object(F.array(new))).otherwise(F.to_variant_object(F.array(v)))
        return F.struct(k.alias("key"), F.variant_get(value, "$[0]", "variant").alias("value"), F.coalesce(hits, r["hits"], none).alias("hits"))

    kept = [c for c in rows.columns if c != "line"]
    parsed = rows.withColumn("_e", F.transform(F.map_entries(F.from_json("line", "map<string,variant>")), entry))
    made = F.map_from_entries(F.transform("_e", lambda x: F.struct(x["key"], x["value"])))
    return parsed.select(
        *kept,
        F.coalesce(F.to_json(made, {"ignoreNullFields": "false"}), F.col("line")).alias("line"),
        F.coalesce(F.flatten(F.transform("_e", lambda x: x["hits"])), none).alias("hits"),
    )


def scrub_messages(
    rows: DataFrame,
    columns: Sequence[Declared],
    rules: RuleSet,
    *,
    field_rules: RuleSet | None = None,
    all_fields: bool = False,
) -> DataFrame:
    """Rows (batch_id, row_no, message): with message redacted, and hits.

    In PID lines declared PHI fields that are not blank are redacted (all declared ones with all_fields): by token, else by
    field_rules (rules unless given), else with the generic token. All other lines pass the rules."""
    by_field = field_rules or rules
    at: dict[int, Declared] = {}
    for c in columns:
        n = position(c.column_name)
        if n is not None and (c.is_phi or all_fields):
            at[n] = c

    none = F.array().cast("array<string>")

    def field(cell: Column, n: int) -> Column:
        """The field's new text and hits."""
        token = field_token(at[n])
        if token is not None:
            new = F.struct(F.lit(token).alias("text"), F.array(F.lit(COLUMN_RULES[token])).alias("hits"))
        else:
            generic = F.struct(F.lit(GENERIC).alias("text"), F.array(F.lit(COLUMN_RULES[GENERIC])).alias("hits"))
            plain = lambda r: F.struct(r["text"].alias("text"), r["hits"].alias("hits"))
            new = let(by_field.redact(cell), lambda r: F.when(F.size(r["hits"]) > 0, plain(r)).otherwise(generic))
        return F.when(blank(cell), F.struct(cell.alias("text"), none.alias("hits"))).otherwise(new)

    def pid(parts: Column) -> Column:
        cells = F.array(*[field(F.get(parts, n), n) for n in at])
        text = lambda x: F.array_join(with_replaced(parts, {n: F.get(x, i)["text"] for i, n in enumerate(at)}), "|")
        return let(cells, lambda x: F.struct(text(x).alias("text"), F.flatten(F.transform(x, lambda c: c["hits"])).alias("hits")))

    def line(x: Column) -> Column:
        same = F.struct(x.alias("text"), none.alias("hits"))
        other = let(rules.redact(x), lambda r: F.struct(r["text"].alias("text"), r["hits"].alias("hits")))
        return F.when(x.startswith("PID|"), let(fields(x), pid) if at else same).otherwise(other)

    done = rows.withColumn("_l", F.transform(lines(F.col("message")), line))
    return done.select(
        *[c for c in rows.columns if c != "message"],
        F.array_join(F.transform("_l", lambda x: x["text"]), "\n").alias("message"),
        F.flatten(F.transform("_l", lambda x: x["hits"])).alias("hits"),
    )


def counts(scrubbed: DataFrame, keys: Sequence[str] = ("batch_id",)) -> DataFrame:
    """By key: rows, replacements (a rule counts once for each cell it hits) and the distinct rules applied, in order."""
    one = scrubbed.groupBy(*keys).agg(F.count("*").alias("total_rows"), F.sum(F.size("hits")).cast("long").alias("replacements"))
    ids = scrubbed.select(*keys, F.explode("hits").alias("r")).groupBy(*keys).agg(F.sort_array(F.collect_set("r")).alias("rules"))
    out = one.join(ids, list(keys), "left")
    return out.withColumn("rules", F.coalesce("rules", F.array().cast("array<string>")))
