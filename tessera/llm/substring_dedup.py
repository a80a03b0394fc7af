"""Substring dedup: Rabin-Karp hashes of every fixed-length word window.

1. Each task hashes all windows of its documents, twice: with independent word
   hashes and bases, so that windows of different words do not pass for equal
   (128 bits inside a batch; 80 and those of the bucket between batches).  Inside a batch, windows that
   also start in a document with a smaller id of that batch are marked at once;
   only the smallest document's windows go on, so a passage that a third of all
   documents share sends one entry per batch, not one per document.
2. The hashes are shuffled by value as packed blobs (see ``grams``); a bucket
   marks the windows whose hashes also start in a smaller document.
3. Marks go back by batch, where they merge into maximal removal intervals of
   each document, and the intervals meet the text on (doc_id, text hash).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import grams as G
from tessera.llm.common import task_count, text_rows

WINDOW = 50
_BLOB = "bucket int, batch long, kind int, payload binary"
_MARKS, _DOCS = 0, 1


def _batch_rows(batch: int, ids: list, keys: list, lengths: list, hashes: list, seconds: list, buckets: int):
    """Rows (bucket, batch, kind, payload) of one batch of documents."""
    real = np.array([G.NO_ID if i is None else i for i in ids], dtype=np.int64)
    isnull = np.array([i is None for i in ids], dtype=bool)
    sizes = np.array([len(h) for h in hashes], dtype=np.int64)
    h = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)
    second = np.concatenate(seconds) if seconds else np.empty(0, dtype=np.uint64)
    doc = np.repeat(np.arange(len(ids)), sizes)
    pos = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    marked = np.zeros(len(h), dtype=bool)
    marked[G.repeats(h, second, real[doc])] = True
    table = G.join_parts([G.pack_signed(real), np.packbits(isnull).tobytes(),
                          np.array(keys, dtype="<i8").tobytes(), G.pack_ints(np.array(lengths))])
    yield batch % buckets, batch, _DOCS, table
    if marked.any():
        yield batch % buckets, batch, _MARKS, G.join_parts(G.pack_entries(doc[marked], pos[marked]))
    h, second, doc, pos = h[~marked], second[~marked], doc[~marked], pos[~marked]
    for bucket, at in G.by_bucket(h, buckets):
        yield bucket, batch, 2, G.join_parts([
            *G.pack_entries(doc[at], pos[at]), G.pack_signed(real[np.unique(doc[at])]), G.pack_hashes(h[at]), G.pack_short(second[at])])


def _to_arrow(rows) -> Iterator[pa.RecordBatch]:
    for bucket, batch, kind, payload in rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array([bucket], pa.int32()), pa.array([batch], pa.int64()), pa.array([kind], pa.int32()),
             pa.array([payload], pa.binary())], names=["bucket", "batch", "kind", "payload"])


def _hash_windows(window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rolling, other = G.WordDigests(), G.Rolling(window), G.Rolling(window, G.SECOND_ODD)
        task, limit = TaskContext.get().partitionId() << 24, G.batch_limit(buckets)
        ids, keys, lengths, hashes, seconds, n, made = [], [], [], [], [], 0, 0
        for rb in batches:
            for i, k, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), G.texts_of(rb.column(2))):
                w = (text or b"").split()
                both = words.of(w)
                h = rolling.hashes(both[:, 0])
                seconds.append(other.hashes(both[:, 1]))
                ids.append(i)
                keys.append(k)
                lengths.append(len(w))
                hashes.append(h)
                n += len(h)
                if n >= limit:
                    yield from _to_arrow(_batch_rows(task + made, ids, keys, lengths, hashes, seconds, buckets))
                    ids, keys, lengths, hashes, seconds, n, made = [], [], [], [], [], 0, made + 1
        if ids:
            yield from _to_arrow(_batch_rows(task + made, ids, keys, lengths, hashes, seconds, buckets))
    return run


def _mark_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: windows whose hashes also start in a smaller document."""
    hs, seconds, owner, docs, poss, which = [], [], [], [], [], []
    for rb in batches:
        for bucket, batch, kind, payload in zip(*(rb.column(c).to_pylist() for c in range(4))):
            if kind != 2:
                yield from _to_arrow([(bucket, batch, kind, payload)])
                continue
            *entries, ids, h, second = G.split_parts(payload)
            d, counts, pos = G.unpack_entries(entries)
            hs.append(G.unpack_hashes(h))
            seconds.append(G.unpack_short(second))
            docs.append(np.repeat(d, counts).astype(np.int32))
            owner.append(np.repeat(G.unpack_signed(ids), counts))
            poss.append(pos.astype(np.int32))
            which.append(np.full(len(pos), batch, dtype=np.int64))
    if not hs:
        return
    h, second, own = np.concatenate(hs), np.concatenate(seconds), np.concatenate(owner)
    del hs, seconds, owner
    at = G.repeats(h, second, own)
    del h, second, own
    which, doc, pos = (np.concatenate(x)[at] for x in (which, docs, poss))
    cuts = np.flatnonzero(G.group_starts(which)) if len(which) else []
    for a, b in zip(cuts, [*cuts[1:], len(which)]):
        yield from _to_arrow([(0, int(which[a]), _MARKS, G.join_parts(G.pack_entries(doc[a:b], pos[a:b])))])


def _intervals(window: int):
    def run(table: pa.Table) -> pa.Table:
        """One batch: its documents' marked windows as maximal intervals of words."""
        docs, poss, head = [], [], None
        for kind, payload in zip(table.column("kind").to_pylist(), table.column("payload").to_pylist()):
            parts = G.split_parts(payload)
            if kind == _DOCS:
                head = parts
            else:
                d, counts, pos = G.unpack_entries(parts)
                docs.append(np.repeat(d, counts))
                poss.append(pos)
        doc = np.concatenate(docs) if docs else np.empty(0, dtype=np.int64)
        pos = np.concatenate(poss) if poss else np.empty(0, dtype=np.int64)
        order = np.lexsort((pos, doc))
        doc, pos = doc[order], pos[order]
        new = G.group_starts(doc)
        new[1:] |= pos[1:] > pos[:-1] + window
        first = np.flatnonzero(new)
        last = np.append(first[1:] - 1, len(doc) - 1) if len(first) else first
        begin, end, owner = pos[first], pos[last] + window, doc[first]
        cut = np.flatnonzero(G.group_starts(owner))
        ids, keys = G.unpack_signed(head[0]), np.frombuffer(head[2], dtype="<i8")
        isnull = np.unpackbits(np.frombuffer(head[1], dtype=np.uint8))[:len(ids)].astype(bool)
        which = owner[cut]
        bounds = np.append(cut, len(owner)).astype(np.int32)
        return pa.table({
            "h_id": pa.array(ids[which], pa.int64(), mask=isnull[which]),
            "h_key": pa.array(keys[which], pa.int64()),
            "starts": pa.ListArray.from_arrays(pa.array(bounds), pa.array(begin, pa.int32())),
            "ends": pa.ListArray.from_arrays(pa.array(bounds), pa.array(end, pa.int32()))})
    return run


def removal_intervals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(h_id, h_key, starts, ends): word intervals to remove, for documents that have any.

    A word is removed when some window of ``window`` words that covers it also
    starts in a document with a smaller id; windows are judged on the input.
    """
    base = text_rows(docs, F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("row_key"), "text")
    n = task_count(docs.sparkSession)
    blobs = base.mapInArrow(G.releasing(_hash_windows(window, n)), _BLOB)
    marks = blobs.repartitionById(n, F.col("bucket")).mapInArrow(G.releasing(_mark_repeats), _BLOB)
    return (marks.groupBy("batch").applyInArrow(
        _intervals(window), "h_id bigint, h_key bigint, starts array<int>, ends array<int>")
        .dropDuplicates(["h_id", "h_key"]))


def _kept(words: list[bytes], starts: list[int], ends: list[int]) -> list[bytes]:
    out, at = [], 0
    for s, e in zip(starts, ends):
        out += words[at:s]
        at = e
    return out + words[at:]


def _apply(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            ids, n_words, n_removed, sha, texts = rb.column(0), [], [], [], []
            for text, s, e in zip(G.texts_of(rb.column(1)), rb.column(2).to_pylist(), rb.column(3).to_pylist()):
                words = (text or b"").split()
                kept = _kept(words, s, e) if s else words
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                joined = b" ".join(kept)
                sha.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    texts.append(joined.decode("utf-8"))
            cols = [ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                cols.append(pa.array(texts, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def without_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept text.

    Defined cases: null text has no words; texts shorter than a window lose
    nothing; a null id counts as larger than every id, and null ids are not
    smaller than each other; rows that share an id never remove each other's
    words; repeated rows are each returned; empty tables give no rows; other
    columns are not read.
    """
    spans = removal_intervals(docs, window)
    base = text_rows(docs, F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("row_key"), "text")
    joined = base.join(spans, base.doc_id.eqNullSafe(spans.h_id) & (base.row_key == spans.h_key), "left")
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    return joined.select("doc_id", "text", "starts", "ends").mapInArrow(
        G.releasing(_apply(with_text)), schema + (", kept_text string" if with_text else ""))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h
  FROM d, unnest(generate_series(1, len(w) - 49)) AS s(i)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS low FROM win) WHERE low < doc_id),
gone AS (SELECT DISTINCT doc_id, p FROM hit, unnest(generate_series(i, i + 49)) AS s(p)),
words AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(generate_series(1, len(w))) AS s(p)),
kept AS (
  SELECT words.doc_id, count(*) FILTER (gone.p IS NOT NULL) AS n_removed,
         string_agg(word, ' ' ORDER BY words.p) FILTER (gone.p IS NULL) AS text
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
