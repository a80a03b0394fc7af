"""Periodic run detection: maximal repetitions of words, and their collapse.

A run is a stretch of words with smallest period q that no neighbouring word
extends.  Here it counts from ``EXPONENT`` periods and ``LEAST`` words on.

1. Stretches that can hold a run: a run of at least four periods repeats each of
   its ``GRAM``-word windows inside itself, so it lies in a stretch of the
   document whose windows all occur again.  Window hashes of a whole batch are
   counted at once; a false match only makes a stretch longer.  A run is maximal in
   its stretch exactly when it is maximal in the document.
2. Ukkonen's suffix trees of the stretch and of its reversal, with Euler tours
   and range minima over them: the longest common extension of two places, to
   the right and to the left, is the string depth of a lowest common ancestor
   and takes constant time.
3. Candidates: the longest Lyndon words from every place, under the order of
   the symbols and under the opposite one (next smaller suffixes, by the order
   of the tree's leaves).  The root of every run is among them; it is extended
   in both directions.

One map pass without a shuffle.  What a task holds is bounded by an Arrow batch of
texts and the longest text's trees (about 1 KB a word of the longest stretch).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import grams as G
from tessera.llm.common import text_rows

EXPONENT = 4
LEAST = 6
GRAM = 4
SCHEMA = ("row {id}, n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
          "runs_sha256 string, collapsed_sha256 string, runs array<struct<start:bigint,length:bigint,period:bigint>>")

Run = tuple[int, int, int]  # start, length, period


class SuffixTree:
    """Ukkonen's tree of symbols >= 1, closed by the symbol 0."""

    def __init__(self, symbols: list[int]):
        s = self.symbols = [*symbols, 0]
        n = len(s)
        kids, start, end, link = [{}], [0], [0], [0]
        node = edge = length = waiting = 0
        for i, c in enumerate(s):
            waiting += 1
            made = 0
            while waiting:
                if not length:
                    edge = i
                a = s[edge]
                k = kids[node].get(a)
                if k is None:
                    kids[node][a] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    kids.append(None)
                    if made:
                        link[made] = node
                        made = 0
                else:
                    span = end[k] - start[k]
                    if length >= span:
                        edge += span
                        length -= span
                        node = k
                        continue
                    at = start[k] + length
                    if s[at] == c:
                        if made and node:
                            link[made] = node
                        length += 1
                        break
                    m = len(start)
                    start += (start[k], i)
                    end += (at, n)
                    link += (0, 0)
                    kids[node][a] = m
                    kids += ({s[at]: k, c: m + 1}, None)
                    start[k] = at
                    if made:
                        link[made] = m
                    made = m
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        self.kids, self.start, self.end = kids, start, end

    def tour(self) -> tuple[list[int], list[int], list[int]]:
        """String depths along the Euler tour, each suffix's place in it, and the suffixes in order."""
        kids, start, end, n = self.kids, self.start, self.end, len(self.symbols)
        depths, place, order = [], [0] * n, []
        todo = [(0, 0)]
        while todo:
            v, d = todo.pop()
            if v >= 0 and kids[v] is None:
                place[n - d] = len(depths)
                order.append(n - d)
            elif v >= 0:
                k = kids[v]
                for c in sorted(k, reverse=True):
                    w = k[c]
                    todo.append((-1, d))  # back at this node after the child
                    todo.append((w, d + end[w] - start[w]))
            depths.append(d)
        return depths, place, order

    def opposite_order(self) -> list[int]:
        """The suffixes in the order of reversed symbols; the closing symbol stays the smallest."""
        kids, start, end, n = self.kids, self.start, self.end, len(self.symbols)
        order, todo = [], [(0, 0)]
        while todo:
            v, d = todo.pop()
            k = kids[v]
            if k is None:
                order.append(n - d)
                continue
            for c in sorted(k):
                if c:
                    todo.append((k[c], d + end[k[c]] - start[k[c]]))
            if 0 in k:
                todo.append((k[0], d + end[k[0]] - start[k[0]]))
        return order


class Extensions:
    """Longest common extensions of pairs of suffixes, in constant time each."""

    def __init__(self, depths: list[int], place: list[int]):
        self.place = np.array(place)
        row = np.array(depths, dtype=np.int32)
        self.rows = [row]
        step = 1
        while 2 * step <= len(depths):
            row = np.minimum(row[:-step], row[step:])
            self.rows.append(row)
            step *= 2

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For i != j: how many symbols the suffixes at i and at j share."""
        a, b = self.place[i], self.place[j]
        a, b = np.minimum(a, b), np.maximum(a, b) + 1
        level = np.frexp((b - a).astype(float))[1] - 1  # floor of the binary logarithm
        out = np.empty(len(a), dtype=np.int64)
        for k in np.unique(level):
            at, row = level == k, self.rows[k]
            out[at] = np.minimum(row[a[at]], row[b[at] - (1 << int(k))])
        return out


def _next_smaller(order: list[int]) -> np.ndarray:
    """For each suffix the next place with a smaller one: where the longest Lyndon word from it ends."""
    rank = [0] * len(order)
    for r, i in enumerate(order):
        rank[i] = r
    out, open_ = [0] * len(order), []
    for i, r in enumerate(rank):
        while open_ and rank[open_[-1]] > r:
            out[open_.pop()] = i
        open_.append(i)
    return np.array(out[:-1], dtype=np.int64)  # the closing symbol is smaller than all


def runs_of(symbols: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> list[Run]:
    """All runs of a sequence with at least ``exponent`` (2 or more) periods and ``least`` symbols, by start and period."""
    n = len(symbols)
    if n < 2:
        return []
    s = (np.unique(symbols, return_inverse=True)[1] + 1).tolist()
    tree, back = SuffixTree(s), SuffixTree(s[::-1])
    depths, place, order = tree.tour()
    right, left = Extensions(depths, place), Extensions(*back.tour()[:2])
    i = np.arange(n)
    ends = [_next_smaller(order), _next_smaller(tree.opposite_order())]
    i, j = np.concatenate([i, i]), np.concatenate(ends)
    i, j = i[j < n], j[j < n]
    stop = j + right.of(i, j)
    start = i.copy()
    inner = i > 0
    start[inner] -= left.of(n - i[inner], n - j[inner])  # place k - 1 is n - k in the reversal
    period, length = j - i, stop - start
    good = length >= np.maximum(least, exponent * period)
    found = np.unique(np.stack([start[good], period[good], length[good]], axis=1), axis=0)
    return [(a, m, q) for a, q, m in found.tolist()]


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _stretches(ids: np.ndarray, sizes: np.ndarray, rolling: G.Rolling) -> tuple[np.ndarray, np.ndarray]:
    """Half-open stretches of words, in all documents of a batch laid end to end, whose windows occur again in their document."""
    none = np.empty(0, dtype=np.int64)
    h = rolling.hashes(G.mix(ids.astype(np.uint64) + np.uint64(1)))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    if not len(h):
        return none, none
    inside = np.flatnonzero(doc[:len(h)] == doc[GRAM - 1:])  # windows of one document
    key = G.mix(h[inside] ^ G.mix(doc[inside].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(G.group_starts(key[order]))
    count = np.diff(np.append(first, len(order)))
    at = np.sort(inside[order[np.repeat(count > 1, count)]])
    if not len(at):
        return none, none
    new = G.group_starts(at - np.arange(len(at)), doc[at])
    begin = np.flatnonzero(new)
    return at[begin], at[np.append(begin[1:] - 1, len(at) - 1)] + GRAM


def periodic_tail(doc_id: int, n: int) -> tuple[int, int] | None:
    """(a, p): words from a on repeat with period p, in one document of ten; by the id's checksum."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _dropped(runs: list[Run]) -> list[tuple[int, int]]:
    """Merged stretches of words that go: each run but its first period."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s + q, s + m) for s, m, q in runs):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _detect(planted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = G.Rolling(GRAM)
        for rb in batches:
            for part in range(0, rb.num_rows, 256):
                yield _batch(rb.slice(part, 256), rolling, planted)
    return run


def _batch(rb: pa.RecordBatch, rolling: G.Rolling, planted: bool) -> pa.RecordBatch:
    names, texts, ids = _Words(), [], []
    for doc_id, text in zip(rb.column(1).to_pylist(), G.texts_of(rb.column(2))):
        w = (text or b"").split()
        tail = periodic_tail(doc_id, len(w)) if planted and doc_id is not None else None
        if tail:
            a, p = tail
            root = w[a:a + p]
            w = (w[:a] + root * -(-(len(w) - a) // p))[:len(w)]
        texts.append(w)
        ids.append(np.fromiter(map(names.__getitem__, w), dtype=np.int64, count=len(w)))
    sizes = np.array([len(w) for w in texts], dtype=np.int64)
    base = np.cumsum(sizes) - sizes
    every = np.concatenate(ids) if ids else np.empty(0, dtype=np.int64)
    found: list[list[Run]] = [[] for _ in texts]
    begin, end = _stretches(every, sizes, rolling)
    long = end - begin >= LEAST
    owner = np.searchsorted(base, begin, side="right") - 1
    for a, b, d in zip(begin[long].tolist(), end[long].tolist(), owner[long].tolist()):
        shift = a - int(base[d])
        found[d] += [(s + shift, m, q) for s, m, q in runs_of(every[a:b])]
    out: list[list] = [[] for _ in range(9)]
    for w, runs in zip(texts, found):
        runs.sort(key=lambda r: (r[0], r[2]))
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
        kept, at = [], 0
        for a, b in _dropped(runs):
            kept += w[at:a]
            at = b
        kept = kept + w[at:] if runs else w
        row = (len(w), len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
               hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
               hashlib.sha256(b" ".join(kept)).hexdigest(), [dict(zip(("start", "length", "period"), r)) for r in runs])
        for c, v in zip(out, row):
            c.append(v)
    kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [
        pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))]
    return pa.RecordBatch.from_arrays(
        [rb.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))],
        names=["row", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs"])


def periodic_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_runs, the run of greatest exponent, digests, and all runs.

    ``planted`` replaces the words from a place on by a repetition of the first of them,
    in the one document of ten that ``periodic_tail`` names by its id.

    ``collapsed_sha256`` is the digest of the words that stay when each run
    loses all but its first period.

    Defined cases: null, empty or blank text has no words and no run (four
    nulls, digests of the empty string); a null id is never changed by
    ``planted``; a text of one repeated word is one run of period 1; equal
    exponents go to the smallest start, then period; repeated rows are each
    returned; empty tables give no rows; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return text_rows(docs, F.col("doc_id").alias("row"), F.col("doc_id").cast("bigint").alias("id"), "text").mapInArrow(
        G.releasing(_detect(planted)), SCHEMA.format(id=kind)).withColumnRenamed("row", "doc_id")
