"""Column expressions for the string handling that CSS values share. All of them stay inside Catalyst."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: An argument list in parentheses up to three deep, or an unclosed one up to the end.
ARGUMENTS = r"\((?:[^()]|\((?:[^()]|\([^()]*+\))*+\))*+\)|\([\s\S]*+$"


def kept(build: Callable) -> Callable:
    """Columns that are costly to put together are built once for each application and arguments."""
    found: dict[tuple, object] = {}

    @wraps(build)
    def get(*args):
        from pyspark import SparkContext

        key = (SparkContext._active_spark_context.applicationId, *args)
        if key not in found:
            found[key] = build(*args)
        return found[key]

    return get


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with the value computed once, however often it is named there: expressions stay small."""
    return F.get(F.transform(F.array(value), body), 0)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def present(c: Column) -> Column:
    """The trimmed text, null if nothing is left of it."""
    return let(trimmed(c), lambda t: F.when(t != "", t))


def number(c: Column) -> Column:
    """A decimal number as scripts read it: blanks around it don't matter, nothing is 0, anything else is null."""
    return let(trimmed(c), lambda t: F.when(t == "", 0.0).when(t.rlike(NUMBER), t.try_cast("double")))


def split_top(c: Column, separator: str) -> Column:
    """Parts at separators outside parentheses; "," or " " (any white space). Empty parts are left out."""
    stop = "," if separator == "," else r"\s"
    parts = F.regexp_extract_all(c, F.lit(rf"(?:[^(){stop}]|{ARGUMENTS}|\))+"), F.lit(0))
    return F.filter(parts, lambda p: p != "")


def half_up(c: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def number_text(c: Column) -> Column:
    """The shortest text of a number, without a fraction if it is whole."""
    return let(c, lambda n: F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(n.cast("string")))


def title_case(c: Column) -> Column:
    """Words between blanks, hyphens and underscores, each with a capital first letter."""
    words = F.filter(F.split(c, r"[-_\s]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), " ")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), "^-|-$", "")


def collapsed(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, r"\s+", " "))
