"""Scalar function library: the job language's built-ins as native Columns.

Every function maps Column(s) to a Column built from Spark's own expressions,
so it stays inside whole-stage codegen; none is a Python UDF.  Text-to-value
conversions use the ``try_*`` forms so that bad input gives null under ANSI
mode instead of failing the task.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


# ---------------------------------------------------------------- strings

def trim(c: ColumnOrName) -> Column:
    """Trim(s): spaces removed at both ends."""
    return F.trim(_c(c))


def upcase(c: ColumnOrName) -> Column:
    return F.upper(_c(c))


def downcase(c: ColumnOrName) -> Column:
    return F.lower(_c(c))


def length(c: ColumnOrName) -> Column:
    """Len(s)."""
    return F.length(_c(c))


def cat(*cols: ColumnOrName) -> Column:
    """``a : b`` concatenation; any null operand gives null."""
    return F.concat(*[_c(c) for c in cols])


def cat_lit(*parts) -> Column:
    """Concatenation where plain strings are literals, Columns are columns."""
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def cat_sep(sep: str, *cols: ColumnOrName) -> Column:
    """Separator concatenation; nulls are skipped."""
    return F.concat_ws(sep, *[_c(c) for c in cols])


def field(c: ColumnOrName, delim: str, n: int) -> Column:
    """Field(s, delim, n): n-th token (1-based), literal delimiter, '' if absent."""
    return F.split_part(_c(c), F.lit(delim), F.lit(n))


def index(c: ColumnOrName, sub: str, n: int = 1) -> Column:
    """Index(s, sub, n): 1-based position of the n-th occurrence, 0 if none."""
    s = _c(c)
    if n < 1:
        raise ValueError("occurrence must be >= 1")
    if n == 1:
        return F.instr(s, sub)
    occurrences = (F.length(s) - F.length(F.replace(s, F.lit(sub), F.lit("")))) / F.lit(len(sub))
    pos = F.length(F.substring_index(s, sub, n)) + 1
    return F.when(s.isNull(), F.lit(None).cast("int")).when(occurrences >= n, pos).otherwise(F.lit(0))


def substr(c: ColumnOrName, start: int, n: int | None = None) -> Column:
    """s[start, n] with 1-based start (0 is rejected: engines differ on it)."""
    if start < 1:
        raise ValueError("substring start is 1-based")
    s = _c(c)
    if n is None:
        return F.substring(s, start, 2147483647)
    return F.substring(s, start, n)


def checksum(*cols: ColumnOrName) -> Column:
    """Checksum(...): md5 of the '|'-joined text (nulls skipped as in concat_ws)."""
    return F.md5(F.concat_ws("|", *[_c(c).cast("string") for c in cols]))


def digits_only(c: ColumnOrName) -> Column:
    return F.regexp_replace(_c(c), r"[^0-9]", "")


def letters_only(c: ColumnOrName) -> Column:
    return F.regexp_replace(_c(c), r"[^A-Za-z ]", "")


def soundex(c: ColumnOrName) -> Column:
    return F.soundex(_c(c))


def levenshtein(a: ColumnOrName, b: ColumnOrName, threshold: int | None = None) -> Column:
    """Edit distance; with a threshold, -1 when the distance exceeds it."""
    if threshold is None:
        return F.levenshtein(_c(a), _c(b))
    return F.levenshtein(_c(a), _c(b), threshold)


# ---------------------------------------------------------------- semi-structured

def json_field(c: ColumnOrName, path: str) -> Column:
    """Field of a JSON text by JSONPath ('$.a.b')."""
    return F.get_json_object(_c(c), path)


def xml_field(c: ColumnOrName, xpath: str) -> Column:
    """Text of the first node matching an XPath in an XML text."""
    return F.xpath_string(_c(c), F.lit(xpath))


def xml_values(c: ColumnOrName, xpath: str) -> Column:
    """All text values matching an XPath, as array<string>."""
    return F.xpath(_c(c), F.lit(xpath))


def loop_values(c: ColumnOrName, delim: str) -> Column:
    """Loop variable over a delimited list: array of the tokens (explode it)."""
    return F.split(_c(c), _regex_quote(delim))


def _regex_quote(s: str) -> str:
    return "".join("\\" + ch if ch in r".^$*+?{}[]\|()" else ch for ch in s)


# ---------------------------------------------------------------- dates

def current_date(run_ts: str | _dt.date | _dt.datetime | None = None) -> Column:
    """CurrentDate(): the run clock when given, else the session clock."""
    if run_ts is None:
        return F.current_date()
    return F.to_date(F.lit(str(run_ts)))


def run_clock(run_ts: str | _dt.datetime) -> Column:
    """A fixed run timestamp (wall clock, no time zone) so replays agree."""
    return F.to_timestamp_ntz(F.lit(str(run_ts)))


def current_timestamp(run_ts: str | _dt.datetime | None = None) -> Column:
    """CurrentTimestamp()/CurrentTime(): the run clock when given."""
    if run_ts is None:
        return F.localtimestamp()
    return run_clock(run_ts)


def years_from_date(d: ColumnOrName, run_date) -> Column:
    """YearsFromDate: whole years from d to the run date."""
    return F.floor(F.months_between(current_date(run_date), _c(d)) / 12).cast("int")


def months_from_date(d: ColumnOrName, run_date) -> Column:
    """MonthsFromDate: fractional months from d to the run date."""
    return F.months_between(current_date(run_date), _c(d), roundOff=False)


def days_since(d: ColumnOrName, run_date) -> Column:
    """DaysSince / DaysFromDate: whole days from d to the run date."""
    return F.datediff(current_date(run_date), _c(d))


def date_from_days_since(n: ColumnOrName) -> Column:
    """DateFromDaysSince: internal day number counted from 1967-12-31."""
    return F.date_add(F.lit(_dt.date(1967, 12, 31)), _c(n).cast("int"))


def date_to_string(d: ColumnOrName, fmt: str = "yyyy-MM-dd") -> Column:
    """Oconv(d, "D-YMD[4,2,2]") / DateToString."""
    return F.date_format(_c(d), fmt)


def year(d: ColumnOrName) -> Column:
    return F.year(_c(d))


def month(d: ColumnOrName) -> Column:
    return F.month(_c(d))


def day(d: ColumnOrName) -> Column:
    return F.dayofmonth(_c(d))


def day_name(d: ColumnOrName) -> Column:
    """DayNameFromDate: full English day name."""
    return F.date_format(_c(d), "EEEE")


def is_weekend(d: ColumnOrName) -> Column:
    """1 for Saturday/Sunday, else 0 (null date gives null)."""
    dow = F.dayofweek(_c(d))
    return F.when(dow.isNull(), F.lit(None).cast("int")).when(dow.isin(1, 7), 1).otherwise(0)


def date_diff(end: ColumnOrName, start: ColumnOrName) -> Column:
    return F.datediff(_c(end), _c(start))


# ---------------------------------------------------------------- nulls and logic

def is_null(c: ColumnOrName) -> Column:
    return _c(c).isNull()


def is_not_null(c: ColumnOrName) -> Column:
    return _c(c).isNotNull()


def set_null(dtype: str | T.DataType = "string") -> Column:
    """SetNull() / @NULL as a typed null."""
    return F.lit(None).cast(dtype)


def null_to_value(c: ColumnOrName, *defaults) -> Column:
    """NullToValue(c, v), or a default chain."""
    return F.coalesce(_c(c), *[_lit(d) for d in defaults])


def if_then_else(*branches, otherwise=None) -> Column:
    """If..Then..Else If..Else chain; first true branch wins, null counts as false."""
    if not branches:
        raise ValueError("need at least one (condition, value) branch")
    expr = None
    for cond, val in branches:
        expr = F.when(cond, _lit(val)) if expr is None else expr.when(cond, _lit(val))
    return expr.otherwise(_lit(otherwise)) if otherwise is not None else expr


def mod(a: ColumnOrName, b) -> Column:
    """Mod(a, b): sign of the dividend; a zero divisor gives null."""
    return F.try_mod(_c(a), _lit(b))


def abs_(c: ColumnOrName) -> Column:
    return F.abs(_c(c))


def sqrt(c: ColumnOrName) -> Column:
    return F.sqrt(_c(c))


def all_of(*preds: Column) -> Column:
    """AND of predicates; a null predicate counts as false."""
    return reduce(lambda a, b: a & b, [F.coalesce(p, F.lit(False)) for p in preds])


def any_of(*preds: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(p, F.lit(False)) for p in preds])


# ---------------------------------------------------------------- conversions

def convert_to_numeric(c: ColumnOrName, precision: int = 18, scale: int = 4) -> Column:
    """ConvertToNumeric / StringToDecimal: invalid text gives null.

    The scale is kept at 4 by default so that the threshold test does not see a
    rounded value (0.006 must stay below 0.01).
    """
    return F.trim(_c(c).cast("string")).try_cast(T.DecimalType(precision, scale))


_MASK = (("%yyyy", "yyyy"), ("%yy", "yy"), ("%mm", "MM"), ("%dd", "dd"),
         ("%hh", "HH"), ("%nn", "mm"), ("%ss", "ss"))


def translate_mask(mask: str) -> str:
    """Job date mask ('%yyyy-%mm-%dd') to a Spark datetime pattern."""
    out = mask
    for src, dst in _MASK:
        out = out.replace(src, dst)
    return out


def string_to_date(c: ColumnOrName, mask: str = "%yyyy-%mm-%dd") -> Column:
    """StringToDate(s, mask): invalid text gives null."""
    return F.try_to_date(_c(c), translate_mask(mask))


def to_string(c: ColumnOrName) -> Column:
    return _c(c).cast("string")


def clamp_non_negative(c: ColumnOrName) -> Column:
    """Null or negative becomes 0."""
    x = _c(c)
    return F.when(x.isNull() | (x < 0), F.lit(0)).otherwise(x)


def salt(n: int, *key_cols: ColumnOrName) -> Column:
    """Deterministic salt in [0, n) from a hash of the row key (replays agree)."""
    return F.pmod(F.xxhash64(*[_c(c) for c in key_cols]), F.lit(n)).cast("int")


def uuid_key() -> Column:
    return F.expr("uuid()")


def row_text(*cols: ColumnOrName) -> Column:
    """Each value as length:text, a null as '-': no two different rows share a text."""
    text = [_c(c).cast("string") for c in cols]
    return F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(
        F.concat(F.char_length(t).cast("string"), F.lit(":"), t)) for t in text])


def row_hash(*cols: ColumnOrName, algo: str = "md5") -> Column:
    """Hash of several columns (H13) over ``row_text``, so separators or null marks inside values hide no change."""
    if algo == "md5":
        return F.md5(row_text(*cols))
    if algo.startswith("sha"):
        return F.sha2(row_text(*cols), int(algo[3:] or 256))
    raise ValueError(algo)
