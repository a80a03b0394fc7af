"""Line dedup over range-partitioned line hashes.

1. Tasks emit, for each distinct long line key of a document, its 128-bit hash
   with the document and the line positions.  No text leaves the task.
2. The entries are range-partitioned on (hash, document) and sorted by hash,
   document and position.  As the document is part of the range key, a line that
   a third of all documents share is spread over many partitions.
3. Each partition streams its sorted entries, a batch at a time.  Between batches
   it holds the open hash group only, and of that, once enough documents have the
   line, only the latest document: what stands before it is dropped at once.
   A partition's first and last group may go on in a neighbour, so what is left of
   them stays open and sends one summary row each (at most two per partition, broadcast).
4. Dropped positions go back by document and become compressed keep bitmaps.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored, task_count, text_rows
from tessera.llm.grams import group_starts, releasing, texts_of

MIN_CHARS = 40
MIN_DOCS = 5
_STRIP = b" \t\n\x0b\x0c\r"
_NO_ID = np.iinfo(np.int64).min
_ENTRY = "hi bigint, lo bigint, doc bigint, row_key bigint, at array<int>"
_DROP, _OPEN, _SUMMARY = 0, 1, 2
_DECIDED = _ENTRY + ", state int, n bigint"


def _line_keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            hi, lo, doc, key, at = [], [], [], [], []
            for i, k, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), texts_of(rb.column(2))):
                seen: dict[bytes, list[int]] = {}
                for n, line in enumerate((text or b"").split(b"\n")):
                    line = line.strip(_STRIP)
                    if len(line) >= min_chars and (line.isascii() or len(line.decode()) >= min_chars):
                        seen.setdefault(xxhash.xxh3_128_digest(line.lower()), []).append(n)
                for h, positions in seen.items():
                    hi.append(int.from_bytes(h[:8], "big", signed=True))
                    lo.append(int.from_bytes(h[8:], "big", signed=True))
                    doc.append(_NO_ID if i is None else i)
                    key.append(k)
                    at.append(positions)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x, pa.int64()) for x in (hi, lo, doc, key)), pa.array(at, pa.list_(pa.int32()))],
                names=["hi", "lo", "doc", "row_key", "at"])
    return run


def _with_state(rows: pa.Table, state: int) -> Iterator[pa.RecordBatch]:
    yield from (rows.append_column("state", pa.array(np.full(len(rows), state, dtype=np.int32)))
                .append_column("n", pa.array(np.zeros(len(rows), dtype=np.int64))).to_batches())


def _summary(hi: int, lo: int, doc: int, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([x], pa.int64()) for x in (hi, lo, doc, 0)] + [pa.array([[]], pa.list_(pa.int32())), pa.array([_SUMMARY], pa.int32()),
                                                                pa.array([n], pa.int64())],
        names=["hi", "lo", "doc", "row_key", "at", "state", "n"])


def _stream(min_docs: int):
    """Decides the groups of one sorted range partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before, first = None, 0, True  # rows of the open group; its documents that went; whether it is the partition's first
        for rb in batches:
            if not rb.num_rows:
                continue
            t = pa.Table.from_batches([rb])
            t = (pa.concat_tables([held, t]) if held is not None else t).combine_chunks()
            hi, lo, doc = (t.column(c).to_numpy() for c in ("hi", "lo", "doc"))
            start = np.flatnonzero(group_starts(hi, lo))
            size = np.diff(np.append(start, len(hi)))
            n_docs = np.add.reduceat(group_starts(hi, lo, doc).astype(np.int64), start)
            n_docs[0] += before
            last = doc[start + size - 1]  # sorted by document: the largest id so far
            drop = np.repeat(n_docs >= min_docs, size) & (doc < np.repeat(last, size))
            yield from _with_state(t.filter(pa.array(drop)), _DROP)
            end = int(start[-1])
            if first and end:  # the first group has ended
                left = ~drop
                left[int(size[0]):] = False
                yield from _with_state(t.filter(pa.array(left)), _OPEN)
                yield _summary(int(hi[0]), int(lo[0]), int(last[0]), int(n_docs[0]))
                first = False
            stay = ~drop
            stay[:end] = False
            held = t.filter(pa.array(stay))
            before = int(n_docs[-1]) - 1 if n_docs[-1] >= min_docs else before if not end else 0
        if held is not None:
            yield from _with_state(held, _OPEN)
            doc = held.column("doc").to_numpy()
            yield _summary(held.column("hi")[0].as_py(), held.column("lo")[0].as_py(), int(doc[-1]),
                           before + int(group_starts(doc).sum()))
    return run


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, row_key, dropped): line positions (from 0) to drop, for rows that have any."""
    base = text_rows(docs, F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("row_key"), "text")
    entries = stored(base.mapInArrow(releasing(_line_keys(min_chars)), _ENTRY), "line-entries")
    ranged = (entries.repartitionByRange(task_count(docs.sparkSession), "hi", "lo", "doc")
              .sortWithinPartitions("hi", "lo", "doc", "row_key"))
    decided = stored(ranged.mapInArrow(releasing(_stream(min_docs)), _DECIDED), "line-decided")
    summary = (decided.filter(F.col("state") == _SUMMARY).groupBy("hi", "lo")
               .agg(F.sum("n").alias("docs"), F.max("doc").alias("largest")).filter(F.col("docs") >= min_docs))
    open_rows = (decided.filter(F.col("state") == _OPEN).join(F.broadcast(summary), ["hi", "lo"])
                 .filter(F.col("doc") < F.col("largest")))
    drops = decided.filter(F.col("state") == _DROP).select("doc", "row_key", "at").union(
        open_rows.select("doc", "row_key", "at"))
    return drops.groupBy("doc", "row_key").agg(
        F.array_distinct(F.flatten(F.collect_list("at"))).alias("dropped"))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        n_dropped, maps = [], []
        for n, gone in zip(rb.column(2).to_pylist(), rb.column(3).to_pylist()):
            keep = np.ones(n, dtype=bool)
            if gone:
                keep[gone] = False
            n_dropped.append(n - int(keep.sum()))
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        yield pa.RecordBatch.from_arrays(
            [*rb.columns[:3], pa.array(n_dropped, pa.int64()), pa.array(maps, pa.binary())],
            names=["doc_id", "row_key", "n_lines", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per distinct (doc_id, row_key): n_lines, n_dropped, keep (zlib of packed bits, one per line).

    A line's key is the line without ASCII white space at its ends, A-Z lower
    case.  Keys of at least ``min_chars`` code points in at least ``min_docs``
    documents lose all their lines except in the largest doc_id that holds them.

    Defined cases: null or empty text is one empty line; null ids count together
    as one document that is smaller than all others; rows that share an id are
    one document for the counts and keep their own bitmaps; repeated rows share
    one bitmap; empty tables give no rows; other columns are not read.
    """
    gone = dropped_lines(docs, min_chars, min_docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("row_key"),
                       (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"))) + 1)
                       .cast("bigint").alias("n_lines")).distinct()
    gone = gone.withColumnRenamed("row_key", "g_key")
    joined = base.join(gone, (F.coalesce("doc_id", F.lit(int(_NO_ID))) == gone.doc) & (base.row_key == gone.g_key), "left")
    return joined.select("doc_id", "row_key", "n_lines", "dropped").mapInArrow(
        _bitmaps, "doc_id bigint, row_key bigint, n_lines bigint, n_dropped bigint, keep binary")


def _apply(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            sha, texts = [], []
            for text, n, gone, raw in zip(texts_of(rb.column(1)), *(rb.column(c).to_pylist() for c in (2, 3, 4))):
                kept = text or b""
                if gone:
                    keep = np.unpackbits(np.frombuffer(zlib.decompress(raw), dtype=np.uint8))[:n]
                    kept = b"\n".join([x for x, k in zip(kept.split(b"\n"), keep) if k])
                sha.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode())
            cols, names = [rb.column(0), rb.column(2), rb.column(3), pa.array(sha, pa.string())], [
                "doc_id", "n_lines", "n_dropped", "kept_sha256"]
            if with_text:
                cols.append(pa.array(texts, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, with_text: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_dropped, kept_sha256 and, if asked for, the kept text."""
    base = text_rows(docs, F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("row_key"), "text")
    maps = bitmaps.select(F.col("doc_id").alias("b_id"), F.col("row_key").alias("b_key"), "n_lines", "n_dropped", "keep")
    joined = base.join(maps, base.doc_id.eqNullSafe(maps.b_id) & (base.row_key == maps.b_key))
    schema = "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string"
    return joined.select("doc_id", "text", "n_lines", "n_dropped", "keep").mapInArrow(
        releasing(_apply(with_text)), schema + (", kept_text string" if with_text else ""))


SQL = r"""
WITH l AS (
  SELECT doc_id, i, lines[i] AS line,
         translate(regexp_replace(lines[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents) d,
       unnest(generate_series(1, len(lines))) AS s(i)),
common AS (
  SELECT key, max(doc_id) AS largest FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT l.doc_id, i, line, coalesce(l.doc_id < largest, false) AS gone FROM l LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
