"""Row-rule builders (constraints, validation rules).

Each returns a boolean Column that is true when the row passes.  A rule that
evaluates to null is treated as failing by the operators that consume rules
(``constrain``, ``route``, ``flag_rules``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.basic import _c, convert_to_numeric, string_to_date


def not_null(c) -> Column:
    return _c(c).isNotNull()


def not_blank(c) -> Column:
    x = _c(c)
    return x.isNotNull() & (F.trim(x) != "")


def in_set(c, values) -> Column:
    return _c(c).isin(list(values))


def between(c, lo=None, hi=None) -> Column:
    x = _c(c)
    preds = []
    if lo is not None:
        preds.append(x >= F.lit(lo))
    if hi is not None:
        preds.append(x <= F.lit(hi))
    out = preds[0]
    for p in preds[1:]:
        out = out & p
    return out


def non_negative(c) -> Column:
    return _c(c) >= 0


def positive(c) -> Column:
    return _c(c) > 0


def length_eq(c, n: int, trim: bool = True) -> Column:
    x = F.trim(_c(c)) if trim else _c(c)
    return F.length(x) == n


def length_between(c, lo: int, hi: int) -> Column:
    n = F.length(_c(c))
    return (n >= lo) & (n <= hi)


def parses_as(c, kind: str, mask: str = "%yyyy-%mm-%dd") -> Column:
    """True when the text converts: kind 'date' or 'numeric'."""
    if kind == "date":
        return string_to_date(F.trim(_c(c)), mask).isNotNull()
    if kind == "numeric":
        return convert_to_numeric(c).isNotNull()
    raise ValueError(kind)


def matches(c, pattern: str) -> Column:
    return _c(c).rlike(pattern)


def passes(rule: Column) -> Column:
    """A rule with null outcome counts as failed."""
    return F.coalesce(rule, F.lit(False))
