"""Order-dependent row logic without a single-task window.

A window with no partition (global row number, lag over the whole set) puts
every row on one task, and a window partitioned by a hot key puts that key's
rows on one task.  The operators here instead:

1. append a tie-break so the order is total (all remaining columns);
2. cut (group keys, order) into ranges of like size, so a hot group is spread
   over several of them;
3. compute the per-range part of the answer locally, and carry values
   over range boundaries through a small table.  Because ranges follow
   (keys, order), only the group at the start of a range can continue from an
   earlier one, so the carry table has at most one row per range: its size is
   bounded by their count and it is broadcast.

Grouped logic (sequence numbers, running sums, lag and lead) takes its ranges from
explicit bounds (``ranges``): rows are sent by range number, and windows on
(range, keys) reuse that layout, so the full rows are exchanged once and a
recomputed task sees the same rows.  An input that is more than a scan is
checkpointed first, as it is read three times; steps that follow each other on the
same keys and order go on with the rows as they lie.  The global row number range-partitions,
sorts and checkpoints to the shared folder, and reads each row's partition
number and position from ``monotonically_increasing_id`` of the checkpointed
rows.  Every task handles at most one range's worth of rows, whatever the key skew.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.ranges import column_name, with_range
from tessera.session import ensure_checkpoint_dir

_PART, _IDX, _MID = "_nb_part", "_nb_idx", "_nb_mid"
_LOW33 = (1 << 33) - 1

OrderSpec = Sequence[str | Column]


def _orderable(dt: T.DataType) -> bool:
    if isinstance(dt, T.MapType) or type(dt).__name__ == "VariantType":
        return False
    if isinstance(dt, T.StructType):
        return all(_orderable(f.dataType) for f in dt.fields)
    if isinstance(dt, T.ArrayType):
        return _orderable(dt.elementType)
    return True


def _names_in(order: OrderSpec) -> set[str]:
    """Columns that the order names, as they are; a repeated sort column would decide nothing."""
    return {n for n in (o if isinstance(o, str) else column_name(o) for o in order) if n}


def total_order(df: DataFrame, keys: Sequence[str], order: OrderSpec) -> list[Column]:
    """Sort expressions: keys, then the order, then every other column as tie-break."""
    used = set(keys) | _names_in(order)
    tie = [F.col(f.name).asc() for f in df.schema.fields
           if f.name not in used and _orderable(f.dataType)]
    return [F.col(k).asc() for k in keys] + [F.col(o).asc() if isinstance(o, str) else o for o in order] + tie


def ordered_partitions(df: DataFrame, sort_exprs: Sequence[Column],
                       num_partitions: int | None = None) -> DataFrame:
    """Range-partition + sort + checkpoint; adds partition number and position."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    staged = df.repartitionByRange(n, *sort_exprs).sortWithinPartitions(*sort_exprs)
    ck = staged.checkpoint(eager=True)
    mid = F.monotonically_increasing_id()
    return (ck.withColumn(_MID, mid)
            .withColumn(_PART, F.shiftright(F.col(_MID), 33).cast("int"))
            .withColumn(_IDX, F.col(_MID).bitwiseAND(F.lit(_LOW33)))
            .drop(_MID))


def _null_safe_join(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "left") -> DataFrame:
    r = right
    for c in cols:
        r = r.withColumnRenamed(c, f"_r_{c}")
    cond = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in cols]
    expr = cond[0]
    for c in cond[1:]:
        expr = expr & c
    return left.join(F.broadcast(r), expr, how).drop(*[f"_r_{c}" for c in cols])


def global_row_number(df: DataFrame, order: OrderSpec, out: str = "row_num", start: int = 1,
                      num_partitions: int | None = None, unique: bool = False) -> DataFrame:
    """Contiguous 1..n (from ``start``) over a total order, distributed.

    ``unique`` says that ``order`` has no ties, which leaves the other columns out of the sort.
    """
    exprs = [F.col(o).asc() if isinstance(o, str) else o for o in order] if unique else total_order(df, [], order)
    parts = ordered_partitions(df, exprs, num_partitions)
    counts = parts.groupBy(_PART).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(_PART, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    res = parts.join(F.broadcast(offsets), _PART, "inner")
    return (res.withColumn(out, F.col("_off") + F.col(_IDX) + F.lit(start))
            .drop("_off", _PART, _IDX).select(*df.columns, out))


_CHEAP = {"Project", "Filter", "Union", "Generate", "Expand", "Range", "LocalRelation", "LogicalRelation", "LogicalRDD", "InMemoryRelation",
          "DataSourceV2ScanRelation"}


def settled(df: DataFrame) -> DataFrame:
    """The frame itself if it is scans with projections and filters, else checkpointed.

    Ranges read their input three times (sample, summary, rows); a join, aggregate or earlier
    numbering is not to be computed that often, nor a chain of numberings ever more often.
    Values that differ between two reads (random ones) are fixed by the checkpoint too.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    todo = [plan] if plan.deterministic() else []
    if not todo:
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    while todo:
        node = todo.pop()
        if node.nodeName() not in _CHEAP and not node.nodeName().startswith("Relation"):
            ensure_checkpoint_dir(df.sparkSession)
            return df.checkpoint(eager=True)
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return df


@dataclass
class _Laid:
    """Rows in ranges of (keys, order): ``base`` with their range, ``parts`` sent by range, ``rows`` with later results too.

    ``window`` is over ``rows`` and breaks ties by the later results as well, ``base_window`` over ``parts``.
    """
    keys: list[str]
    order: list[str | Column]
    ranges: int
    base: DataFrame
    parts: DataFrame
    rows: DataFrame
    window: WindowSpec
    base_window: WindowSpec

    def serves(self, keys: Sequence[str], order: OrderSpec, ranges: int, col: str | None) -> bool:
        return (self.keys == list(keys) and self.ranges == ranges and len(self.order) == len(order)
                and all(a is b or (isinstance(a, str) and isinstance(b, str) and a == b) for a, b in zip(self.order, order))
                and (col is None or col in self.base.columns))


def _segment_frame(df: DataFrame, keys: Sequence[str], order: OrderSpec, num_partitions: int | None, col: str | None = None) -> _Laid:
    """The rows laid out in ranges; as they lie already if ``df`` is what the same keys and order gave before.

    A chain of numberings of one order is thus exchanged once.  ``col`` is
    summed up from the base rows: a result of the chain itself begins a new layout.
    """
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = getattr(df, "_laid", None)
    exprs = total_order(df, keys, order)
    window = Window.partitionBy(_PART, *keys).orderBy(*exprs)
    if laid is not None and laid.serves(keys, order, n, col):
        return replace(laid, window=window)
    df = settled(df)
    tagged = with_range(df, exprs, n, _PART)
    parts = tagged.repartitionById(n, F.col(_PART))
    return _Laid(list(keys), list(order), n, tagged, parts, parts, window, window)


def _result(laid: _Laid, rows: DataFrame, columns: Sequence[str], outs: Sequence[str]) -> DataFrame:
    """The columns and results, remembering the layout for the next step."""
    res = rows.select(*columns, *outs)
    if len({*columns, *outs, _PART}) == len(columns) + len(outs) + 1:
        res._laid = replace(laid, rows=rows.select(*columns, *outs, _PART))
    return res


def group_row_number(df: DataFrame, keys: Sequence[str], order: OrderSpec, out: str = "seq",
                     skew_safe: bool = True, num_partitions: int | None = None) -> DataFrame:
    """Sequence number within a group (G1); ``keys=[]`` gives the global number."""
    if not keys:
        return global_row_number(df, order, out, 1, num_partitions)
    if not skew_safe:
        w = Window.partitionBy(*keys).orderBy(*total_order(df, [], order))
        return df.withColumn(out, F.row_number().over(w))
    laid = _segment_frame(df, keys, order, num_partitions)
    local = laid.rows.withColumn("_lrn", F.row_number().over(laid.window))
    summ = laid.base.groupBy(_PART, *keys).agg(F.count(F.lit(1)).alias("_n"))
    wk = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    carry = (summ.withColumn("_off", F.sum("_n").over(wk))
             .filter(F.col("_off").isNotNull()).select(_PART, *keys, "_off"))
    res = _null_safe_join(local, carry, [_PART, *keys])
    res = res.withColumn(out, (F.coalesce(F.col("_off"), F.lit(0)) + F.col("_lrn")).cast("int"))
    return _result(laid, res, df.columns, [out])


def is_first(df: DataFrame, keys: Sequence[str], order: OrderSpec, out: str = "is_first",
             skew_safe: bool = True) -> DataFrame:
    """First-of-group flag."""
    seq = group_row_number(df, keys, order, "_seq", skew_safe)
    return seq.withColumn(out, (F.col("_seq") == 1)).drop("_seq")


def running_sum(df: DataFrame, keys: Sequence[str], order: OrderSpec, col: str,
                out: str = "running_total", skew_safe: bool = True,
                num_partitions: int | None = None) -> DataFrame:
    """Running total per group in order (G3); ``keys=[]`` runs over the whole set."""
    if keys and not skew_safe:
        w = (Window.partitionBy(*keys).orderBy(*total_order(df, [], order))
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return df.withColumn(out, F.sum(col).over(w))
    laid = _segment_frame(df, keys, order, num_partitions, col)
    local = laid.rows.withColumn("_lsum", F.sum(col).over(laid.window.rowsBetween(Window.unboundedPreceding, 0)))
    summ = laid.base.groupBy(_PART, *keys).agg(F.sum(col).alias("_s"), F.count(F.col(col)).alias("_c"))
    wk = (Window.partitionBy(*keys) if keys else Window).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    carry = (summ.withColumn("_off", F.sum("_s").over(wk)).withColumn("_offc", F.sum("_c").over(wk))
             .filter(F.col("_offc") > 0).select(_PART, *keys, "_off"))
    res = _null_safe_join(local, carry, [_PART, *keys])
    total = F.when(F.col("_lsum").isNull() & F.col("_off").isNull(), F.lit(None)) \
        .otherwise(F.coalesce(F.col("_lsum"), F.lit(0)) + F.coalesce(F.col("_off"), F.lit(0)))
    return _result(laid, res.withColumn(out, total), df.columns, [out])


def shifted(df: DataFrame, keys: Sequence[str], order: OrderSpec, col: str, out: str,
            direction: str = "lag", skew_safe: bool = True, num_partitions: int | None = None,
            has_col: str | None = None) -> DataFrame:
    """Previous (lag) or next (lead) value of ``col`` within a group.

    ``has_col`` adds a boolean telling whether a previous/next row exists
    (so a stored null can be told from the group edge).
    """
    if keys and not skew_safe:
        w = Window.partitionBy(*keys).orderBy(*total_order(df, [], order))
        fn = F.lag if direction == "lag" else F.lead
        res = df.withColumn(out, fn(col, 1).over(w))
        if has_col:
            res = res.withColumn(has_col, fn(F.lit(1), 1).over(w).isNotNull())
        return res
    laid = _segment_frame(df, keys, order, num_partitions, col)
    fn = F.lag if direction == "lag" else F.lead
    placed = lambda rows, w: (rows.withColumn("_lrn", F.row_number().over(w))
                              .withColumn("_lcnt", F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding,
                                                                                        Window.unboundedFollowing))))
    local = placed(laid.rows.withColumn("_lv", fn(col, 1).over(laid.window)), laid.window)
    edges = placed(laid.parts, laid.base_window).filter((F.col("_lrn") == 1) | (F.col("_lrn") == F.col("_lcnt")))
    summ = edges.groupBy(_PART, *keys).agg(F.max_by(col, "_lrn").alias("_last"), F.min_by(col, "_lrn").alias("_first"))
    wk = (Window.partitionBy(*keys) if keys else Window).orderBy(_PART)
    if direction == "lag":
        carry = (summ.withColumn("_has", F.lag(F.lit(1), 1).over(wk))
                 .withColumn("_cv", F.lag("_last", 1).over(wk)))
        edge = F.col("_lrn") == 1
    else:
        carry = (summ.withColumn("_has", F.lead(F.lit(1), 1).over(wk))
                 .withColumn("_cv", F.lead("_first", 1).over(wk)))
        edge = F.col("_lrn") == F.col("_lcnt")
    carry = carry.filter(F.col("_has").isNotNull()).select(_PART, *keys, "_cv", "_has")
    res = _null_safe_join(local, carry, [_PART, *keys])
    res = res.withColumn(out, F.when(edge, F.col("_cv")).otherwise(F.col("_lv")))
    if has_col:
        res = res.withColumn(has_col, F.when(edge, F.col("_has").isNotNull()).otherwise(F.lit(True)))
    return _result(laid, res, df.columns, [out, has_col] if has_col else [out])


def change_flag(df: DataFrame, order: OrderSpec, col: str, keys: Sequence[str] = (),
                prev_out: str = "prev_value", flag_out: str = "changed",
                skew_safe: bool = True) -> DataFrame:
    """Previous value and change flag over an ordered set.

    The first row has no previous value and is flagged changed; the compare
    is null-safe.
    """
    s = shifted(df, list(keys), order, col, prev_out, "lag", skew_safe, has_col="_hp")
    return (s.withColumn(flag_out, (~F.col("_hp")) | ~F.col(col).eqNullSafe(F.col(prev_out)))
            .drop("_hp"))


def next_key(df: DataFrame, key: str) -> int:
    """max(key) + 1 of an existing table (1 when empty): one scalar to the driver."""
    v = df.agg(F.max(key)).first()[0]
    return 1 if v is None else int(v) + 1


def assign_keys(df: DataFrame, out: str, order: OrderSpec, start: int = 1,
                contiguous: bool = True) -> DataFrame:
    """Surrogate keys.

    Contiguous keys run start, start+1, ... over a total order (continue an
    existing table with ``start=next_key(table, key)``).  Non-contiguous keys
    are unique but gapped and need no shuffle.
    """
    if not contiguous:
        return df.withColumn(out, F.monotonically_increasing_id() + F.lit(start))
    return global_row_number(df, order, out, start)


def with_row_number(df: DataFrame, order: OrderSpec, out: str = "row_number") -> DataFrame:
    """1-based input row number (@INROWNUM) over a stated total order (C11)."""
    return global_row_number(df, order, out, 1)
