"""Transformer-stage operators: derivations, constraints, stage variables,
multi-output routing, classification, audit columns and job parameters.

All of them add expressions to one projection/filter; Catalyst collapses the
chain into a single codegen'd stage.  Multi-output operators return a dict of
DataFrames that share one parent plan (persist the parent when several outputs
are written, so the input is read once).
"""

from __future__ import annotations

import dataclasses
import datetime as _dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _true(p: Column) -> Column:
    """Predicate where null counts as false."""
    return F.coalesce(p, F.lit(False))


def _not_true(p: Column) -> Column:
    """NOT coalesce(p, false), written so Spark can push it to the scan
    (``isnull(a > c)`` simplifies to ``isnull(a)``)."""
    return ~p | p.isNull()


def derive(df: DataFrame, derivations: Mapping[str, Column], keep: Sequence[str] | None = None) -> DataFrame:
    """Add or replace columns in one projection.

    ``keep`` restricts the output to those columns (in that order) afterwards.
    """
    out = df.withColumns(dict(derivations))
    return out.select(*keep) if keep is not None else out


def derive_staged(df: DataFrame, variables: Mapping[str, Column],
                  outputs: Mapping[str, Column] | None = None, drop: bool = True) -> DataFrame:
    """Stage variables (C4): evaluated in order, each may use the previous ones.

    ``outputs`` are derivations that may use the variables; with ``drop`` the
    temporaries are removed afterwards.  Catalyst inlines them into one projection.
    """
    out = df
    for name, expr in variables.items():
        out = out.withColumn(name, expr)
    if outputs:
        out = out.withColumns(dict(outputs))
    return out.drop(*variables) if drop else out


def drop_vars(df: DataFrame, variables: Mapping[str, Column] | Sequence[str]) -> DataFrame:
    return df.drop(*list(variables))


def constrain(df: DataFrame, predicates: Sequence[Column] | Column) -> DataFrame:
    """Keep rows for which every predicate is true (C3); null fails.

    The predicates go to ``filter`` as they are: a filter already drops rows
    whose predicate is null, and an unwrapped predicate can be pushed down to
    the Parquet scan (a ``coalesce(p, false)`` wrapper could not).
    """
    preds = [predicates] if isinstance(predicates, Column) else list(predicates)
    if not preds:
        return df
    return df.filter(reduce(lambda a, b: a & b, preds))


def route(df: DataFrame, links: Mapping[str, Column], otherwise: str | None = "otherwise",
          exclusive: bool = False) -> dict[str, DataFrame]:
    """Multi-output router.

    Each link gets the rows whose predicate is true.  ``exclusive`` gives each
    row to the first matching link only.  ``otherwise`` receives the rows no
    link took, including rows whose predicates were all null.
    """
    out: dict[str, DataFrame] = {}
    seen: list[Column] = []
    for name, pred in links.items():
        # the link's own predicate stays unwrapped and the negated earlier
        # links use the pushable form, so every link's filter reaches the scan
        p = pred
        if exclusive and seen:
            p = reduce(lambda a, b: a & b, [p, *[_not_true(q) for q in seen]])
        out[name] = df.filter(p)
        seen.append(pred)
    if otherwise is not None:
        out[otherwise] = df.filter(reduce(lambda a, b: a & b, [_not_true(q) for q in seen])) if seen else df
    return out


def route_union(df: DataFrame, links: Mapping[str, Column], otherwise: str | None = "otherwise",
                exclusive: bool = False, link_col: str = "link") -> DataFrame:
    """All router outputs as one DataFrame with a link column (one scan).

    A row going to several links appears once per link (explode of the
    matching link names), so the union is computed without re-reading input.
    """
    names = list(links)
    flags = []
    for i, n in enumerate(names):
        p = _true(links[n])
        if exclusive:
            for prev in names[:i]:
                p = p & ~_true(links[prev])
        flags.append(F.when(p, F.lit(n)))
    any_link = reduce(lambda a, b: a | b, [_true(links[n]) for n in names])
    if otherwise is not None:
        flags.append(F.when(~any_link, F.lit(otherwise)))
    return df.withColumn(link_col, F.explode(F.array_compact(F.array(*flags))))


def classify(df: DataFrame, name: str, cases: Sequence[tuple[Column, object]], default=None) -> DataFrame:
    """Classification column instead of a split (C6): first true case wins."""
    expr = None
    for cond, label in cases:
        v = label if isinstance(label, Column) else F.lit(label)
        expr = F.when(_true(cond), v) if expr is None else expr.when(_true(cond), v)
    expr = expr.otherwise(default if isinstance(default, Column) else F.lit(default))
    return df.withColumn(name, expr)


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested columns to flat ones, by a walk over the schema.

    * A struct becomes its fields, named by their path (``order_customer_id``); a
      null struct gives nulls.
    * An array becomes rows, one per element, under the array's name; an empty or
      null array keeps its row, with a null (``explode_outer``).  Two arrays beside
      each other give every combination of their elements.
    * A map becomes rows of ``<name>_key`` and ``<name>_value``, in the same way.

    It goes on until nothing nested is left.  Names are taken in schema order, without
    regard to case; one that is taken gets the next free number
    (``order_id_2``).  Other columns keep their names.  One projection or
    generator per nested column: no shuffle, whatever the depth.
    """
    out = df
    while True:
        fields = out.schema.fields
        at = next((i for i, f in enumerate(fields) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))), None)
        if at is None:
            return out
        taken = {f.name.lower() for i, f in enumerate(fields) if i != at}

        def free(name: str, taken=taken) -> str:
            found, n = name, 2
            while found.lower() in taken:
                found, n = f"{name}{sep}{n}", n + 1
            taken.add(found.lower())
            return found
        name, kind = fields[at].name, fields[at].dataType
        quoted = [F.col("`" + f.name.replace("`", "``") + "`") for f in fields]
        if isinstance(kind, T.StructType):
            new = [quoted[at].getField(f.name).alias(free(f"{name}{sep}{f.name}")) for f in kind.fields]
        elif isinstance(kind, T.ArrayType):
            new = [F.explode_outer(quoted[at]).alias(name)]
        else:
            new = [F.explode_outer(quoted[at]).alias(free(f"{name}{sep}key"), free(f"{name}{sep}value"))]
        out = out.select(*quoted[:at], *new, *quoted[at + 1:])


def with_audit(df: DataFrame, job: str, run_id: str, run_ts: str | _dt.datetime,
               processed_by: str | None = None, prefix: str = "") -> DataFrame:
    """Audit/metadata columns (C10) from a fixed run clock so replays agree."""
    return df.withColumns({
        f"{prefix}process_ts": F.to_timestamp_ntz(F.lit(str(run_ts))),
        f"{prefix}job_name": F.lit(job),
        f"{prefix}run_id": F.lit(run_id),
        f"{prefix}processed_by": F.lit(processed_by or job),
    })


@dataclasses.dataclass
class Params:
    """Job parameters (#NAME#) with defaults; an empty run date means today."""

    defaults: Mapping[str, object]
    run_date_key: str | None = "RUN_DATE"

    def resolve(self, overrides: Mapping[str, object] | None = None,
                today: _dt.date | None = None) -> dict[str, object]:
        out = dict(self.defaults)
        for k, v in (overrides or {}).items():
            if k not in out:
                raise KeyError(f"unknown parameter {k}")
            out[k] = v
        if self.run_date_key and self.run_date_key in out and not out[self.run_date_key]:
            out[self.run_date_key] = (today or _dt.date.today()).isoformat()
        return out

    @staticmethod
    def substitute(text: str, values: Mapping[str, object]) -> str:
        """Replace #NAME# markers in a path or SQL text."""
        for k, v in values.items():
            text = text.replace(f"#{k}#", str(v))
        return text
