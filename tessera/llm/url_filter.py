"""URL filters: sort-merge range join of page addresses with host and path rules.

The canonical key of an address is its host with the labels reversed, each
ended by a dot (``www.example.com`` is ``com.example.www.``), then its path.  A rule's host
with all its subdomains is then the interval of keys with the rule's key as
prefix, and intervals of rules are nested or apart.

1. Bounds that cut the addresses into even ranges, from the ``PER_RANGE``
   smallest hashes per range (bounds only decide where a row is handled).  An
   address with very many rows is cut too: the row's hash ends the key.
2. One exchange: an address goes to its range, a rule to each range that its
   interval touches.
3. Each range is sorted with rules before the addresses they cover, and swept
   with a stack of the active nested hosts.  A host on the stack has its paths
   in order, each linked to its longest proper prefix among them, so the longest
   path that begins an address is found by one search and a walk up the links.

A task holds the rules of the hosts that enclose its current address, never its
addresses.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, task_count
from tessera.llm.grams import releasing

PER_RANGE = 64
DEFAULT = "allow"
# (verdict, host, path)
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
_AFTER = "\U0010ffff"  # sorts behind every character that a key can go on with


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    """Labels reversed, each ended by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _bounds(pages: DataFrame, ranges: int) -> list[tuple[str, str, int]]:
    """At most ``ranges`` - 1 rising keys, from a sample of ``PER_RANGE`` rows a range."""
    rows = pages.select("key", "path", "salt").orderBy(F.xxhash64("salt"), "salt", "key", "path").limit(PER_RANGE * ranges).collect()
    keys = sorted({tuple(r) for r in rows})
    return [keys[i * len(keys) // ranges] for i in range(1, ranges) if i * len(keys) // ranges] if keys else []


def _ranges(bounds: list[tuple[str, str, int]], rules: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            key, path, salt = (rb.column(c).to_pylist() for c in ("key", "path", "salt"))
            if not rules:
                at = [bisect_right(bounds, k) for k in zip(key, path, salt)]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *rb.columns], names=["range", *rb.schema.names])
                continue
            lo = [bisect_right(bounds, (k, p, -(1 << 63))) for k, p in zip(key, path)]
            hi = [bisect_right(bounds, (k + _AFTER, "", 0)) for k in key]
            take = np.repeat(np.arange(rb.num_rows), np.subtract(hi, lo) + 1)
            at = [r for a, b in zip(lo, hi) for r in range(a, b + 1)]
            more = rb.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *more.columns], names=["range", *rb.schema.names])
    return run


@dataclass
class _Active:
    """A host on the stack: its paths in order, each with its longest proper prefix among them."""

    key: str
    paths: list[str] = field(default_factory=list)
    up: list[int] = field(default_factory=list)
    rules: list[tuple[str, str]] = field(default_factory=list)  # rule, verdict

    def add(self, path: str, rule: str, verdict: str) -> None:
        if self.paths and self.paths[-1] == path:  # the same rule again: block wins
            if verdict == "block":
                self.rules[-1] = rule, verdict
            return
        before = len(self.paths) - 1
        while before >= 0 and not path.startswith(self.paths[before]):
            before = self.up[before]
        self.paths.append(path)
        self.up.append(before)
        self.rules.append((rule, verdict))

    def longest(self, path: str) -> tuple[str, str] | None:
        i = bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.up[i]
        return self.rules[i] if i >= 0 else None


class Sweep:
    """Rows in the order of (key, path), rules first."""

    def __init__(self) -> None:
        self.stack: list[_Active] = []

    def close(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1].key):
            self.stack.pop()

    def rule(self, key: str, path: str, rule: str, verdict: str) -> None:
        self.close(key)
        if not self.stack or self.stack[-1].key != key:
            self.stack.append(_Active(key))
        self.stack[-1].add(path, rule, verdict)

    def judge(self, key: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits (equally long: that of the longer host)."""
        self.close(key)
        best: tuple[str | None, str | None] = (None, None)
        for level in reversed(self.stack):
            found = level.longest(path)
            if found and (best[0] is None or len(found[0]) > len(best[0])):
                best = found
        return best


def _sweep(default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, at = Sweep(), None
        for rb in batches:
            take, rule, verdict = [], [], []
            cols = [rb.column(c).to_pylist() for c in ("range", "key", "path", "kind", "rule", "verdict")]
            for i, (r, key, path, kind, name, says) in enumerate(zip(*cols)):
                if r != at:
                    sweep, at = Sweep(), r
                if kind == 0:
                    sweep.rule(key, path, name, says)
                    continue
                found = sweep.judge(key, path)
                take.append(i)
                rule.append(found[0])
                verdict.append(found[1] or default)
            kept = rb.select(["page_id", "host", "path"]).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                                             names=["page_id", "host", "path", "rule", "verdict"])
    return run


def judged(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """Per page: page_id, host, path, rule and verdict of the longest rule that fits, else null and ``default``.

    ``pages`` has page_id and url; ``rules`` has verdict, host and path.  A rule fits
    its host and all subdomains where the address's path starts with the rule's.

    Defined cases: a null url, or one without ``://``, has an empty host and
    path, which only a rule with both empty fits; a rule with a null host, path
    or verdict never fits; a rule's host is lower-cased (A-Z); of equally long rules the
    longer host's wins, of rules with the same host and path a block; null page ids and repeated
    rows are each returned; without rules every verdict is the default; empty
    tables give no rows; other columns are not read.
    """
    spark = pages.sparkSession
    n = task_count(spark)
    kind = pages.schema["page_id"].dataType.simpleString()
    url = F.col("url")
    base = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.xxhash64("page_id", "url").alias("salt"))
    base = base.select(host_key(F.col("host")).alias("key"), "path", "salt", "page_id", "host", F.lit(1).alias("kind"),
                       F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    lower = ascii_lower(F.col("host"))
    named = (rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
             .select(host_key(lower).alias("key"), "path", F.lit(0).cast("bigint").alias("salt"),
                     F.lit(None).cast(kind).alias("page_id"), lower.alias("host"), F.lit(0).alias("kind"),
                     F.concat(lower, "path").alias("rule"), "verdict"))
    bounds = _bounds(base, n)
    schema = f"range int, key string, path string, salt bigint, page_id {kind}, host string, kind int, rule string, verdict string"
    rows = (base.mapInArrow(releasing(_ranges(bounds, False)), schema)
            .unionByName(named.mapInArrow(releasing(_ranges(bounds, True)), schema)))
    return (rows.repartitionById(n, F.col("range")).sortWithinPartitions("range", "key", "path", "kind")
            .mapInArrow(releasing(_sweep(default)),
                        f"page_id {kind}, host string, path string, rule string, verdict string"))


SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
rules(says, r_host, r_path) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fit AS (
  SELECT host, path, max_by(r_host || r_path, length(r_host || r_path)) AS rule, max_by(says, length(r_host || r_path)) AS says
  FROM (SELECT DISTINCT host, path FROM q), rules
  WHERE (host = r_host OR suffix(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY host, path)
SELECT q.page_id, q.host, q.path, fit.rule, coalesce(fit.says, 'allow') AS verdict
FROM q LEFT JOIN fit ON q.host = fit.host AND q.path = fit.path
"""
