import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessera import functions as fx
from tessera.functions import rules as R


def one(spark, expr, data=None, schema="s string"):
    df = spark.createDataFrame(data or [("x",)], schema)
    return [r[0] for r in df.select(expr).collect()]


def test_field_is_literal_and_safe(spark):
    # T4: split_part is literal (no regex) and gives '' out of range
    assert one(spark, fx.field("s", ".", 2), [("a.b.c",)]) == ["b"]
    assert one(spark, fx.field("s", ".", 9), [("a.b.c",)]) == [""]


def test_index_nth_occurrence(spark):
    data = [("abcabc",), ("abc",), ("xyz",), (None,)]
    assert one(spark, fx.index("s", "b", 1), data) == [2, 2, 0, None]
    assert one(spark, fx.index("s", "b", 2), data) == [5, 0, 0, None]


def test_substring_rejects_zero_start():
    with pytest.raises(ValueError):
        fx.substr("s", 0, 2)


def test_concat_null_propagates_but_sep_skips(spark):
    data = [("a", None)]
    assert one(spark, fx.cat("s", "t"), data, "s string, t string") == [None]
    assert one(spark, fx.cat_sep("-", "s", "t"), data, "s string, t string") == ["a"]


def test_conversions_do_not_raise(spark):
    # Bad text gives null; scale 4 keeps 0.006 below 0.01
    data = [(" 12.5 ",), ("abc",), ("0.006",), (None,)]
    got = one(spark, fx.convert_to_numeric("s"), data)
    assert got == [Decimal("12.5000"), None, Decimal("0.0060"), None]
    dates = one(spark, fx.string_to_date("s", "%yyyy-%mm-%dd"), [("2024-01-05",), ("2024-13-45",), ("x",)])
    assert dates == [dt.date(2024, 1, 5), None, None]


def test_years_from_date_leap_day(spark):
    got = one(spark, fx.years_from_date(F.col("d"), "2023-02-28"), [(dt.date(2000, 2, 29),)], "d date")
    assert got == [23]


def test_day_name_and_weekend(spark):
    d = [(dt.date(2024, 1, 6),), (dt.date(2024, 1, 8),)]
    assert one(spark, fx.day_name("d"), d, "d date") == ["Saturday", "Monday"]
    assert one(spark, fx.is_weekend("d"), d, "d date") == [1, 0]


def test_mod_sign_and_zero_divisor(spark):
    assert one(spark, fx.mod(F.col("a"), F.col("b")), [(-7, 3), (7, 0)], "a int, b int") == [-1, None]


def test_date_from_days_since(spark):
    assert one(spark, fx.date_from_days_since(F.col("n")), [(1,)], "n int") == [dt.date(1968, 1, 1)]


def test_row_hash_separates_null_and_empty(spark):
    got = one(spark, fx.row_hash("s"), [(None,), ("",)])
    assert got[0] != got[1]


def test_if_then_else_first_match_wins(spark):
    e = fx.if_then_else((F.col("v") > 10, "big"), (F.col("v") > 5, "mid"), otherwise="small")
    assert one(spark, e, [(20,), (7,), (1,), (None,)], "v int") == ["big", "mid", "small", "small"]


def test_rules_null_counts_as_failure(spark):
    df = spark.createDataFrame([(None,), ("A",), ("Z",)], "s string")
    ok = [r[0] for r in df.select(R.passes(R.in_set("s", ["A"]))).collect()]
    assert ok == [False, True, False]


def test_mask_translation_and_timestamps(spark):
    assert fx.translate_mask("%yyyy-%mm-%dd %hh:%nn:%ss") == "yyyy-MM-dd HH:mm:ss"
    got = one(spark, fx.string_to_date("s", "%dd/%mm/%yyyy"), [("05/01/2024",), ("31/02/2024",)])
    assert got == [dt.date(2024, 1, 5), None]
