"""Scalar functions whose semantics differ between typed collection queries and SQL.

Everything else is pyspark.sql.functions as it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def equal(a: Column, b: Column) -> Column:
    """Equality under which null equals null."""
    return a.eqNullSafe(b)


def int_div(a: Column, b: Column) -> Column:
    """Integer division towards zero; division by zero raises."""
    return F.call_function("div", a, b)


def coalesce_to(a: Column, default) -> Column:
    return F.coalesce(a, F.lit(default))


def conditional(test: Column, then: Column, otherwise: Column) -> Column:
    """A null test counts as false."""
    return F.when(F.coalesce(test, F.lit(False)), then).otherwise(otherwise)


def is_null_or_empty(text: Column) -> Column:
    return F.coalesce(F.length(text) == 0, F.lit(True))


def split_on(text: Column, separator: str) -> Column:
    """Parts between a literal separator, empty ones kept; a null text has none."""
    quoted = "".join("\\" + c if not c.isalnum() and c != " " else c for c in separator)
    return F.coalesce(F.split(text, quoted, -1), F.array().cast("array<string>"))


def format_pair(template: str, *values: Column) -> Column:
    """{0}, {1}, ... replaced by the values' text; a null is empty."""
    parts, rest = [], template
    for k, v in enumerate(values):
        head, _, rest = rest.partition("{" + str(k) + "}")
        parts += [F.lit(head), F.coalesce(v.cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1, with null before all else."""
    null_first = F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), -1).when(b.isNull(), 1)
    return null_first.when(a < b, -1).when(a > b, 1).otherwise(0)
