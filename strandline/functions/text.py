"""Scalar text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What strip() takes off; Spark's plain trim takes off spaces only.
WHITE = " \t\n\r\x0b\x0c"

#: The cell texts that the public CSV reader of pandas takes for missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once. Inside a lambda, and in branches that may not be taken, Spark computes an
    expression again wherever it stands."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def blank(c: Column) -> Column:
    """True for null, empty and all-white cells."""
    return F.coalesce(F.length(strip(c)) == 0, F.lit(True))


def null_if_missing(c: Column) -> Column:
    """NA tokens as null."""
    return F.when(~c.isin(*NA_TOKENS), c)


def lines(c: Column) -> Column:
    return F.split(c, r"\r\n|\n|\r")


def fields(line: Column) -> Column:
    """The parts of a pipe-delimited segment."""
    return F.split(line, r"\|")


def starting(parts: Column, prefix: str) -> Column:
    """The elements of an array that start with prefix."""
    return F.filter(parts, lambda x: x.startswith(prefix))


def with_replaced(parts: Column, at: Mapping[int, Column]) -> Column:
    """The array with the elements at the given positions replaced; positions beyond its end are ignored."""

    def pick(x: Column, i: Column) -> Column:
        out = x
        for k, value in at.items():
            out = F.when(i == k, value).otherwise(out)
        return out

    return F.transform(parts, pick)


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def swap_suffix(path: Column, suffix: str) -> Column:
    """The path with its last extension replaced."""
    return F.regexp_replace(path, r"\.[^./]*$", suffix)


def batch_id(source: Column, file_name: Column, at: Column) -> Column:
    """source, file name with dots as underscores, and the second, joined by underscores."""
    return F.concat_ws("_", source, F.replace(file_name, F.lit("."), F.lit("_")), F.date_format(at, "yyyyMMddHHmmss"))


def content_id(source: Column, file_name: Column, sha: Column) -> Column:
    """Like batch_id, by content: files of one name within one second stay apart, and a repeated file has one id."""
    return F.concat_ws("_", source, F.replace(file_name, F.lit("."), F.lit("_")), F.substring(sha, 1, 16))
