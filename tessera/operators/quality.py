"""Validation, reject outputs, profiling and run metrics.

Counting is always one aggregate over one plan (``count_if`` per rule), never
one Spark action per rule; good and reject outputs are two filters over the
same lazily shared plan (persist it when both are written).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import numbering


def _ok(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


def flag_rules(df: DataFrame, rules: Mapping[str, Column], valid_col: str = "is_valid",
               prefix: str = "ok_") -> DataFrame:
    """One boolean column per rule (null counts as failed) plus the AND of all (V1)."""
    flags = {f"{prefix}{n}": _ok(p) for n, p in rules.items()}
    out = df.withColumns(flags)
    return out.withColumn(valid_col, reduce(lambda a, b: a & b, [F.col(c) for c in flags]))


def failed_rules(rules: Mapping[str, Column], name: str = "failed_rules") -> Column:
    """array<string> of the names of the rules a row fails."""
    return F.array_compact(F.array(*[F.when(~_ok(p), F.lit(n)) for n, p in rules.items()])).alias(name)


def split_rejects(df: DataFrame, rules: Mapping[str, Column],
                  reason_col: str = "failed_rules") -> tuple[DataFrame, DataFrame]:
    """Good/reject split (V2): rejects carry the names of every failed rule."""
    tagged = df.withColumn(reason_col, failed_rules(rules, reason_col))
    good = tagged.filter(F.size(reason_col) == 0).drop(reason_col)
    bad = tagged.filter(F.size(reason_col) > 0)
    return good, bad


def error_code(checks: Sequence[tuple[str, str, Column]], none: str | None = "") -> tuple[Column, Column]:
    """First failing check's code and description (V3).

    ``checks`` are (code, description, fails_when) in priority order; a null
    ``fails_when`` does not fire.  Returns (code, description) Columns, with
    ``none`` when no check fails.
    """
    code = None
    desc = None
    for c, d, fails in checks:
        cond = _ok(fails)
        code = F.when(cond, F.lit(c)) if code is None else code.when(cond, F.lit(c))
        desc = F.when(cond, F.lit(d)) if desc is None else desc.when(cond, F.lit(d))
    return code.otherwise(F.lit(none)), desc.otherwise(F.lit(none))


def with_reject_info(bad: DataFrame, run_ts: str | _dt.datetime, rejected_by: str,
                     source_file: str | Column | None = None, row_number_col: str | None = None) -> DataFrame:
    """Reject metadata (V4): timestamp (run clock), by, source file; row number
    should be computed on the full input beforehand (``row_number_col`` keeps it)."""
    cols = {"RejectedTimestamp": F.to_timestamp_ntz(F.lit(str(run_ts))),
            "RejectedBy": F.lit(rejected_by)}
    if source_file is not None:
        cols["SourceFile"] = source_file if isinstance(source_file, Column) else F.lit(source_file)
    out = bad.withColumns(cols)
    if row_number_col and row_number_col != "RowNumber":
        out = out.withColumnRenamed(row_number_col, "RowNumber")
    return out


def number_input(df: DataFrame, order: Sequence[str | Column], out: str = "RowNumber", unique: bool = False) -> DataFrame:
    """@INROWNUM over the input in a stated order (distributed, see numbering); ``unique``: the order has no ties."""
    return numbering.global_row_number(df, order, out, 1, unique=unique)


def rejection_summary(df: DataFrame, rules: Mapping[str, Column], first_fail: bool = True) -> DataFrame:
    """One-row breakdown per rule (V7), from a single aggregate.

    ``failed_<rule>`` counts every row failing the rule (overlapping counts);
    with ``first_fail`` also ``first_<rule>``: rows whose first failure is it.
    ``rejection_rate_pct`` is null for empty input.
    """
    aggs = [F.count(F.lit(1)).alias("records_input")]
    ok_all = reduce(lambda a, b: a & b, [_ok(p) for p in rules.values()])
    aggs.append(F.count_if(ok_all).alias("records_valid"))
    aggs.append(F.count_if(~ok_all).alias("records_rejected"))
    names = list(rules)
    for n in names:
        aggs.append(F.count_if(~_ok(rules[n])).alias(f"failed_{n}"))
    if first_fail:
        for i, n in enumerate(names):
            cond = ~_ok(rules[n])
            for prev in names[:i]:
                cond = cond & _ok(rules[prev])
            aggs.append(F.count_if(cond).alias(f"first_{n}"))
    out = df.agg(*aggs)
    return out.withColumn("rejection_rate_pct",
                          F.round(F.try_divide(F.col("records_rejected") * F.lit(100.0), F.col("records_input")), 4))


def observed_counts(df: DataFrame, rules: Mapping[str, Column], name: str = "rule_counts"):
    """Attach rule counts to a frame as a Spark observation (V7 option).

    Returns ``(frame, observation)``: the counts (records, valid, rejected and
    one ``failed_<rule>`` per rule) are computed while the frame is written or
    otherwise consumed by its next action, with no extra pass over the input.
    Read them with ``observation.get`` after that action.
    """
    from pyspark.sql import Observation
    obs = Observation(name)
    ok_all = reduce(lambda a, b: a & b, [_ok(p) for p in rules.values()])
    metrics = [F.count(F.lit(1)).alias("records_input"), F.count_if(ok_all).alias("records_valid"),
               F.count_if(~ok_all).alias("records_rejected")]
    metrics += [F.count_if(~_ok(p)).alias(f"failed_{n}") for n, p in rules.items()]
    return df.observe(obs, *metrics), obs


def reject_alert(summary: DataFrame, max_rate_pct: float = 5.0, max_rows: int = 100) -> DataFrame:
    """Alert rows (V8): the summary rows breaking a threshold, with the reason."""
    reason = F.concat_ws("; ",
                         F.when(F.col("rejection_rate_pct") > max_rate_pct,
                                F.concat(F.lit("rate above "), F.lit(str(max_rate_pct)), F.lit("%"))),
                         F.when(F.col("records_rejected") > max_rows,
                                F.concat(F.lit("more than "), F.lit(str(max_rows)), F.lit(" rejects"))))
    return summary.withColumn("alert_reason", reason).filter(F.col("alert_reason") != "")


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null count and share of every column (V9): one aggregate, then unpivot."""
    cols = list(cols or df.columns)
    agg = df.agg(F.count(F.lit(1)).alias("_total"),
                 *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = agg.unpivot(["_total"], cols, "column_name", "null_count")
    return long.select("column_name", F.col("null_count").cast("long").alias("null_count"),
                       F.round(F.try_divide(F.col("null_count") * F.lit(100.0), F.col("_total")), 4)
                       .alias("null_pct"))


def duplicate_keys(df: DataFrame, keys: Sequence[str], name: str = "dup_count") -> DataFrame:
    """Keys occurring more than once (V10), with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).filter(F.col(name) > 1)


def column_profile(df: DataFrame, cols: Sequence[str], approx_median: bool = False) -> DataFrame:
    """min/max/avg/stddev/median/non-null count per numeric column.

    The columns are unpivoted to (column_name, value) so one aggregate gives
    all statistics; the exact median comes from the distributed
    ``exact_percentile``, or a bounded sketch with ``approx_median``.
    """
    from tessera.operators.aggregate import exact_percentile
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"),
                                                  F.col(c).cast("double").alias("v")) for c in cols])).alias("p")) \
        .select("p.*")
    aggs = [F.min("v").alias("min_value"), F.max("v").alias("max_value"), F.avg("v").alias("avg_value"),
            F.stddev_samp("v").alias("stddev_value"), F.count("v").alias("non_null")]
    if approx_median:
        return long.groupBy("column_name").agg(*aggs, F.percentile_approx("v", 0.5, 10000).alias("median_value"))
    stats = long.groupBy("column_name").agg(*aggs)
    med = exact_percentile(long, ["column_name"], "v", 0.5, "median_value")
    return stats.join(med, "column_name", "left").select(
        "column_name", "min_value", "max_value", "avg_value", "stddev_value", "median_value", "non_null")


class ExpectationFailed(AssertionError):
    pass


def expect(df: DataFrame, min_rows: int | None = None, exact_rows: int | None = None,
           not_null: Sequence[str] = ()) -> dict[str, int]:
    """Expectations that fail the run (V13); all measured by one aggregate."""
    aggs = [F.count(F.lit(1)).alias("rows")] + [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in not_null]
    r = df.agg(*aggs).first().asDict()
    problems = []
    if min_rows is not None and r["rows"] < min_rows:
        problems.append(f"rows {r['rows']} < {min_rows}")
    if exact_rows is not None and r["rows"] != exact_rows:
        problems.append(f"rows {r['rows']} != {exact_rows}")
    for c in not_null:
        if r[f"null_{c}"]:
            problems.append(f"{r[f'null_{c}']} null values in {c}")
    if problems:
        raise ExpectationFailed("; ".join(problems))
    return r


def standardize(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Standardise columns (V14): phone -> digits, name -> trimmed single-spaced
    upper case, email -> trimmed lower case, text -> trimmed."""
    out = {}
    for c, kind in kinds.items():
        x = F.col(c)
        if kind == "phone":
            out[c] = F.regexp_replace(x, r"[^0-9]", "")
        elif kind == "name":
            out[c] = F.upper(F.trim(F.regexp_replace(x, r"\s+", " ")))
        elif kind == "email":
            out[c] = F.lower(F.trim(x))
        elif kind == "text":
            out[c] = F.trim(x)
        else:
            raise ValueError(kind)
    return df.withColumns(out)


def job_summary(flagged: DataFrame, valid_col: str = "is_valid") -> DataFrame:
    """records in / out / rejected and status from one aggregate."""
    s = flagged.agg(F.count(F.lit(1)).alias("records_input"),
                    F.count_if(F.col(valid_col)).alias("records_output"),
                    F.count_if(~F.col(valid_col)).alias("records_rejected"))
    return s.withColumn("rejection_rate_pct",
                        F.round(F.try_divide(F.col("records_rejected") * F.lit(100.0), F.col("records_input")), 4)) \
        .withColumn("status", F.when(F.col("records_input") == 0, "EMPTY")
                    .when(F.col("records_rejected") == 0, "SUCCESS").otherwise("SUCCESS_WITH_REJECTS"))


def run_metrics(summary: DataFrame, job: str, run_date: str, run_ts: str,
                input_path: str = "", output_path: str = "") -> DataFrame:
    """Run-metrics row (V16): the job summary plus run identification."""
    return summary.select(
        F.lit(job).alias("job_name"), F.to_date(F.lit(run_date)).alias("run_date"),
        F.to_timestamp_ntz(F.lit(str(run_ts))).alias("execution_timestamp"),
        F.lit(input_path).alias("input_path"), F.lit(output_path).alias("output_path"),
        F.col("records_input").cast("long").alias("records_input"),
        F.col("records_output").cast("long").alias("records_output"),
        F.col("records_rejected").cast("long").alias("records_rejected"),
        F.col("rejection_rate_pct"), F.col("status"))
