"""Small plan helpers: size estimates for broadcast checks, config reads."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Cap for an explicit broadcast hint: Spark's own automatic threshold.  The estimate is
# of the compressed files, and the rows in memory can be several times larger.
DEFAULT_BROADCAST_BYTES = 10 * 1024 * 1024


def estimated_size_bytes(df: DataFrame) -> int | None:
    """Optimizer estimate of the plan's output size (None if unknown)."""
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        return int(str(stats.sizeInBytes()))
    except Exception:  # pragma: no cover - estimate unavailable
        return None


def broadcast_limit(df: DataFrame, default: int = DEFAULT_BROADCAST_BYTES) -> int:
    conf = df.sparkSession.conf.get("tessera.broadcast.maxBytes", None)
    return int(conf) if conf else default


def fits_broadcast(df: DataFrame, limit: int | None = None) -> bool:
    """True only when the optimizer's size estimate is known and under limit."""
    size = estimated_size_bytes(df)
    lim = broadcast_limit(df) if limit is None else limit
    return size is not None and size <= lim


def maybe_broadcast(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Broadcast hint only when the size estimate proves the frame small."""
    from pyspark.sql import functions as F
    return F.broadcast(df) if fits_broadcast(df, limit) else df


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
