"""Toxicity scores from the nearest labelled examples.

Fit (the classifier's bounded part):
* ``SAMPLE`` labelled rows with the smallest id hashes, taken as they come, so
  the classes keep their shares; rows of the held-out third are never used;
* every term of those rows is kept; its weight is its idf (document frequencies
  over all documents) times 1 + sqrt(chi-squared) of term and label among them,
  so that telling terms count more and no term is left out.

Index: the examples' weighted TF-IDF vectors over all terms, unit length, as a
block-max inverted index over blocks of ``BLOCK`` examples:
* terms of few examples have postings, added up for every query.  A posting is a column's
  number only: a term adds the same to all its examples, as far as it stands in them once;
* terms of at least one example in ``FREQUENT_SHARE`` are one matrix product for a
  batch of queries;
* terms in between hold most of the other postings.  For them the index keeps the
  largest weight in each block.  A query first takes the examples with the greatest
  bounds, then those whose bound still reaches the 25th best cosine; all others
  are skipped without a look at these terms.
The matrix and the block maxima are narrow numbers; what remains is added up in double
precision, so the neighbours are those of an exhaustive search, ties by example number.

Terms are words and the first ``STEM`` bytes of longer words, so that inflected
forms share a term.

Score: votes weighted by 1 / (distance + 0.1) next to a fixed mass of prior
votes, so that far neighbours alone decide little; then mapped to a probability by
isotonic regression on the examples' own leave-one-out votes.  Evidence: the
nearest examples with similarity and label.

The index goes to the executors once, as one broadcast of term counts that the votes,
the scores and the filter share; each Python worker builds its tables from it once,
some examples at a time, and numbers terms only if it is given texts.

A score depends on the text and the fitted index only.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored, task_count, text_rows
from tessera.llm.grams import releasing, texts_of
from tessera.llm.license_scan import words_of

SAMPLE = 12_000
NEIGHBOURS = 25
EVIDENCE = 5
STEM = 5
FREQUENT_SHARE = 16  # terms of at least one in so many examples are scored as a matrix
MIDDLE_SHARE = 30  # and of at least one in so many by block maxima
BLOCK = 4
GROUP = 8  # examples of which only the greatest bound is compared at first
FIRST = 48  # examples scored before the bounds are cut
COMMON = 32_768  # terms that are looked up first
QUERIES = 512  # counted texts in one matrix product
TEXTS = 256  # and texts beside the table of words, so that both take little memory
TOGETHER = 16  # of which so many are searched at once
PAIRS = 4096  # pairs of query and example whose terms are read at once
ENTRIES = 1 << 18  # terms of examples that are laid out at once
PORTION = 1 << 20  # bytes of text whose words are numbered at once
SLACK = 1e-4  # more than the narrow numbers of bounds and the matrix product can be off by
PRIOR_MASS = 25.0
THRESHOLD = 0.7


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; remainder 1 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def terms_of(text: bytes | None) -> list[bytes]:
    """The distinct terms of a text."""
    words = set(words_of(text))
    return [*words, *{w[:STEM] + b"*" for w in words if len(w) > STEM}]


def _portions(texts: Iterable[bytes | None]) -> Iterator[list[bytes]]:
    """The texts, null ones empty, in lists of about ``PORTION`` bytes."""
    part, held = [], 0
    for text in texts:
        part.append(text or b"")
        held += len(part[-1])
        if held >= PORTION or len(part) >= QUERIES:
            yield part
            part, held = [], 0
    if part:
        yield part


class TermIds:
    """Term -> number, from terms joined by line breaks (no term has white space).

    ``common`` names the numbers of the most frequent terms: most look-ups end in that
    small table, which stays in a processor's cache.
    """

    def __init__(self, words: bytes, common: np.ndarray | None = None):
        names = words.split(b"\n") if words else []
        self.numbers = {w: i for i, w in enumerate(names)}
        self.common = {names[i]: i for i in (() if common is None else common.tolist())}
        get = self.numbers.get  # each known word's stem, by number; the last is no word's
        self.stem = np.fromiter((get(w[:STEM] + b"*", -1) if len(w) > STEM and w[-1] != 42 else -1 for w in chain(names, [b""])),
                                dtype=np.int32, count=len(names) + 1)

    def counted(self, texts: Iterable[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per text (rising numbers of its known terms, how often each stands in it).

        Each distinct word of a portion of texts that is not common is looked up once.
        """
        width = max(1, len(self.numbers))
        for part in _portions(texts):
            words = [words_of(text) for text in part]
            of = np.repeat(np.arange(len(part)) * width, np.fromiter(map(len, words), dtype=np.int64, count=len(part)))
            words = list(chain.from_iterable(words))
            ids = np.fromiter(map(self.common.get, words, repeat(-1)), dtype=np.int64, count=len(words))
            rest = np.flatnonzero(ids < 0)
            words = list(map(words.__getitem__, rest.tolist()))
            names = list(dict.fromkeys(words))
            place = dict(zip(names, range(len(names))))
            place = np.fromiter(map(place.__getitem__, words), dtype=np.int64, count=len(words))
            known = np.fromiter(map(self.numbers.get, names, repeat(-1)), dtype=np.int64, count=len(names))
            stem = self.stem[known]
            new = np.flatnonzero(known < 0).tolist()  # words that no example has; their stems may be known
            stem[new] = [self.numbers.get(names[i][:STEM] + b"*", -1) if len(names[i]) > STEM else -1 for i in new]
            ids[rest] = known[place]
            stems = self.stem[ids]
            stems[rest] = stem[place]
            terms, n = np.unique(np.concatenate([(of + x)[x >= 0] for x in (ids, stems)]), return_counts=True)
            ends = np.searchsorted(terms, np.arange(len(part) + 1) * width).tolist()
            terms, n = terms % width, n.astype(np.float64)
            yield from ((terms[a:b], n[a:b]) for a, b in zip(ends, ends[1:]))


Vector = tuple[np.ndarray, np.ndarray]  # terms, unit-length weights


def _within(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of several stretches, one after another."""
    end = np.cumsum(size)
    out = np.arange(end[-1] if len(end) else 0)
    out += np.repeat(start - end + size, size)
    return out


class Lists:
    """For each example the entries of some terms: (place of the term in a query, weight), one example after another."""

    def __init__(self, size: np.ndarray, width: int):
        self.size = size  # entries by example
        self.first = np.cumsum(size) - size
        self.width = width  # of a query
        self.places = np.empty(int(size.sum()), dtype=np.min_scalar_type(max(0, width - 1)))
        self.values = np.empty(len(self.places))

    def dot(self, queries: np.ndarray, of: np.ndarray, examples: np.ndarray) -> np.ndarray:
        """Products of queries (weights by place) and examples, for pairs (row of the query, example)."""
        out = np.zeros(len(examples))
        for a in range(0, len(examples), PAIRS):
            e = examples[a:a + PAIRS]
            size = self.size[e]
            end = np.cumsum(size)
            first = end - size
            at = np.repeat(self.first[e] - first, size)
            at += np.arange(len(at))
            place = np.repeat(of[a:a + PAIRS] * self.width, size)
            place += self.places.take(at)
            products = queries.reshape(-1).take(place)
            products *= self.values.take(at)
            some = size > 0
            if some.any():
                out[a:a + PAIRS][some] = np.add.reduceat(products, first[some])
        return out


class Postings:
    """For each term the columns of its examples, one term after another, and what is added to each."""

    def __init__(self, df: np.ndarray, columns: int, values: bool):
        self.df = df.astype(np.int32)
        self.ptr = np.cumsum(df) - df
        self.column = np.empty(int(df.sum()), dtype=np.min_scalar_type(max(0, columns - 1)))
        self.value = np.empty(len(self.column)) if values else None
        self._next = self.ptr.copy()

    def put(self, terms: np.ndarray, column: np.ndarray, value: np.ndarray | None = None) -> None:
        order = np.argsort(terms, kind="stable")
        terms = terms[order]
        new = np.flatnonzero(np.diff(terms, prepend=-1))
        size = np.diff(new, append=len(terms))
        at = _within(self._next[terms[new]], size)
        self._next[terms[new]] += size
        self.column[at] = column[order]
        if value is not None:
            self.value[at] = value[order]

    def done(self) -> None:
        del self._next

    def sums(self, terms: np.ndarray, weights: np.ndarray, columns: int, of: np.ndarray | None = None, queries: int = 1) -> np.ndarray:
        """By column, the sum of the weights of its terms, each times the posting's value if there are values.

        The terms of several queries, ``of`` which each is one, have the columns of one query after another.
        """
        size = self.df[terms]
        at = _within(self.ptr[terms], size)
        added = np.repeat(weights, size)
        if self.value is not None:
            added *= self.value.take(at)
        at = self.column.take(at)
        if of is not None:
            at = np.repeat(of * columns, size) + at
        return np.bincount(at, weights=added, minlength=queries * columns)


class Index:
    """Exact cosine search over bounded examples; see the module's text.

    ``terms`` and ``raw`` hold the examples' vectors, one after another;
    ``sizes`` has their numbers of terms, ``norm`` their lengths.
    """

    def __init__(self, words: bytes, weights: np.ndarray, ids, labels, sizes, terms: np.ndarray, raw, common=None):
        self.text, self.common, self.weights = words, common, weights
        self.ids, self.labels = np.array(ids, dtype=np.int64), np.array(labels, dtype=np.int64)
        self.sizes, self.terms, self.raw = np.array(sizes, dtype=np.int64), terms, raw
        self.first = np.cumsum(self.sizes) - self.sizes
        self.scored = self.asked = 0  # examples whose middle terms were looked at; queries
        n, width = len(self.ids), len(weights)
        blocks = -(-n // (BLOCK * GROUP)) * GROUP
        self.columns = blocks * BLOCK
        df, more = np.zeros(width, dtype=np.int64), np.zeros(width, dtype=np.int64)
        self.norm = np.zeros(n)
        for e, part in self._parts():
            t, values = terms[part], raw(part)
            df += np.bincount(t, minlength=width)
            more += np.bincount(t[values != weights[t]], minlength=width)
            self.norm += np.bincount(e, weights=values * values, minlength=n)
        self.norm = np.sqrt(self.norm)
        often = df * FREQUENT_SHARE >= max(n, 1)
        between = (df * MIDDLE_SHARE >= max(n, 1)) & ~often
        self.frequent, self.middle = (np.where(x, np.cumsum(x) - 1, -1).astype(np.int32) for x in (often, between))
        # Example -> column.  Column c is in block c modulo their number: examples with the same heaviest frequent term
        # stand side by side and so in different blocks, whose other examples then add little to a bound.
        heaviest, most = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.float32)
        has, has_between = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for e, part in self._parts():
            has_between += np.bincount(e[between[terms[part]]], minlength=n)
            at = np.flatnonzero(often[terms[part]])
            e, values = e[at], (raw(part)[at] / self.norm[e[at]]).astype(np.float32)
            has += np.bincount(e, minlength=n)
            np.maximum.at(most, e, values)
            top = np.flatnonzero(values == most[e])[::-1]
            heaviest[e[top]] = self.frequent[terms[part][at[top]]]
        self.example_of = np.argsort(heaviest, kind="stable")
        self.column_of = np.empty(n, dtype=np.int64)
        self.column_of[self.example_of] = np.arange(n)
        self.by_norm = np.zeros(self.columns)
        self.by_norm[self.column_of[self.norm > 0]] = 1.0 / self.norm[self.norm > 0]
        self.often = np.zeros((int(often.sum()), self.columns), dtype=np.float32)
        self.top = np.zeros((int(between.sum()), blocks), dtype=np.float32)
        self.frequent_lists, self.middle_lists = (Lists(x, len(self.often) + len(self.top)) for x in (has, has_between))
        self.place = np.where(often, self.frequent, np.where(between, len(self.often) + self.middle, -1)).astype(np.int32)  # in a query
        # A rare term adds its weight to each of its examples, before these are divided by their lengths;
        # where it stands in one more than once, the difference is a posting of its own.
        rare = ~(often | between)
        self.rare, self.more = Postings(np.where(rare, df, 0), self.columns, False), Postings(np.where(rare, more, 0), self.columns, True)
        put = [0, 0]
        for e, part in self._parts():
            t, values = terms[part], raw(part)
            for i, (row, lists) in enumerate(((self.frequent, self.frequent_lists), (self.middle, self.middle_lists))):
                at = np.flatnonzero(row[t] >= 0)
                to, rows, unit = slice(put[i], put[i] + len(at)), row[t[at]], values[at] / self.norm[e[at]]
                lists.places[to], lists.values[to], put[i] = self.place[t[at]], unit, to.stop
                c = self.column_of[e[at]]
                if i:  # narrow numbers, rounded up
                    np.maximum.at(self.top, (rows, c % max(blocks, 1)), (unit * (1 + 1e-6)).astype(np.float32))
                else:
                    self.often[rows, c] = unit
            at = np.flatnonzero(rare[t])
            t, values, c = t[at], values[at], self.column_of[e[at]]
            self.rare.put(t, c)
            at = np.flatnonzero(values != weights[t])
            self.more.put(t[at], c[at], values[at] - weights[t[at]])
        self.rare.done()
        self.more.done()
        self.example = self.rare.column

    def _parts(self) -> Iterator[tuple[np.ndarray, slice]]:
        """Some entries at a time, those of an example together: (their examples, their places)."""
        end = np.cumsum(self.sizes)
        a = 0
        while a < len(end):
            b = max(a + 1, int(np.searchsorted(end, self.first[a] + ENTRIES, side="right")))
            yield np.repeat(np.arange(a, b), self.sizes[a:b]), slice(int(self.first[a]), int(end[b - 1]))
            a = b

    @cached_property
    def names(self) -> TermIds:
        """Made when texts are looked up: counted terms need none."""
        return TermIds(self.text, self.common)

    @property
    def words(self) -> dict[bytes, int]:
        return self.names.numbers

    @classmethod
    def build(cls, words: list[bytes], weights: np.ndarray, examples: list[tuple[int, int, dict[int, float]]]) -> Index:
        """``examples``: (id, label, word -> weight)."""
        values = np.array([w for _, _, v in examples for w in v.values()], dtype=np.float64)
        return cls(b"\n".join(words), weights, [x[0] for x in examples], [x[1] for x in examples], [len(v) for _, _, v in examples],
                   np.array([t for _, _, v in examples for t in v], dtype=np.int32), lambda part: values[part])

    @classmethod
    def of_state(cls, state: dict) -> Index:
        """From term counts (see ``fit``)."""
        weights, terms, counts = (state[x] for x in ("weights", "terms", "counts"))
        return cls(state["words"], weights, state["ids"], state["labels"], state["sizes"], terms,
                   lambda part: (1.0 + np.log(counts[part], dtype=np.float64)) * weights[terms[part]], state["common"])

    def vector(self, text: bytes | None) -> dict[int, float]:
        """Unit-length weights of a text's terms that some example has."""
        t, w = next(self.vectors_of([text]))
        return dict(zip(t.tolist(), w.tolist()))

    def vectors_of(self, texts: Iterable[bytes | None]) -> Iterator[Vector]:
        """Terms that some example has, and their unit-length weights."""
        return (self.weighted(t, n) for t, n in self.names.counted(texts))

    def weighted(self, t: np.ndarray, n: np.ndarray) -> Vector:
        """The vector of counted terms."""
        w = (1.0 + np.log(n)) * self.weights[t]
        return t, w / math.sqrt(w @ w) if len(w) else w

    def vectors(self, examples: list[int]) -> list[Vector]:
        """The vectors of some examples."""
        parts = [slice(a, a + k) for a, k in zip(self.first[examples].tolist(), self.sizes[examples].tolist())]
        return [(self.terms[p], self.raw(p) / self.norm[e]) for e, p in zip(examples, parts)]

    def _search(self, base: np.ndarray, tops: np.ndarray, queries: np.ndarray, t: np.ndarray, w: np.ndarray, size: np.ndarray,
                k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k nearest examples and more of a few queries, with their cosines: (query, example, cosine).

        ``base`` has the frequent terms' part of every column's cosine and ``tops`` the most that
        the terms in between can add in each block, both narrow; ``queries`` have the weights of these terms,
        ``t`` and ``w`` the rare ones, ``size`` of each query, one query after another.
        """
        m, n = len(queries), len(self.ids)
        exact = np.empty((m, self.columns))
        weights = w * self.weights[t]
        end = np.cumsum(size).tolist()
        for i, (a, b) in enumerate(zip([0, *end], end)):
            exact[i] = self.rare.sums(t[a:b], weights[a:b], self.columns)
        again = np.flatnonzero(self.more.df[t])
        exact += self.more.sums(t[again], w[again], self.columns, np.repeat(np.arange(m), size)[again], m).reshape(m, -1)
        exact *= self.by_norm
        bound = (base.reshape(m, BLOCK, -1) + tops[:, None]).reshape(m, -1)
        bound += exact.astype(np.float32)
        bound[:, n:] = -np.inf
        some = np.flatnonzero(own >= 0)
        bound[some, self.column_of[own[some]]] = -np.inf
        of, seen, scores, added = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0), np.empty(0)
        least = np.full(m, -np.inf)
        for more in (FIRST, n):  # the greatest bounds, then all that can still get in
            if more < n and GROUP * more < n:  # the greatest are in the groups with the greatest of their own
                grouped = bound.reshape(m, GROUP, -1)
                groups = np.argpartition(grouped.max(axis=1), grouped.shape[2] - more, axis=1)[:, grouped.shape[2] - more:]
                left = (np.arange(GROUP)[:, None] * grouped.shape[2] + groups[:, None]).reshape(m, -1)
                bounds = np.take_along_axis(bound, left, axis=1)
                best = np.argpartition(bounds, left.shape[1] - more, axis=1)[:, left.shape[1] - more:]
                q, c = np.repeat(np.arange(m), more), np.take_along_axis(left, best, axis=1).reshape(-1)
                able = bound[q, c] > 0
                q, c = q[able], c[able]
            else:  # a column without a common term has a bound of 0
                q, c = np.nonzero(bound >= np.maximum(least - SLACK, np.finfo(np.float32).tiny).astype(np.float32)[:, None])
            of, seen = np.concatenate([of, q]), np.concatenate([seen, c])
            bound[q, c] = -np.inf
            part = self.middle_lists.dot(queries, q, self.example_of[c])
            added = np.concatenate([added, part])
            scores = np.concatenate([scores, base[q, c] + exact[q, c] + part])
            order = np.lexsort((-scores, of))
            size = np.bincount(of, minlength=m)
            full = np.flatnonzero(size >= k)
            least[full] = scores[order[np.cumsum(size)[full] - size[full] + k - 1]]
        self.scored += len(seen)
        self.asked += m
        good = np.flatnonzero(scores >= np.maximum(least[of], 0.0) - SLACK)
        of, c = of[good], seen[good]
        e = self.example_of[c]
        return of, e, exact[of, c] + added[good] + self.frequent_lists.dot(queries, of, e)

    def nearest_of(self, queries: Iterable[Vector], k: int, without: Iterable[int] | None = None,
                   batch: int = QUERIES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per query (examples, cosines) of the k nearest with a positive cosine; its ``without`` is left out."""
        queries, without = iter(queries), repeat(-1) if without is None else iter(without)
        while some := list(islice(queries, batch)):
            own = np.fromiter(islice(without, len(some)), dtype=np.int64, count=len(some))
            t, w = (np.concatenate(x) for x in zip(*some))
            of = np.repeat(np.arange(len(some)), [len(x) for x, _ in some])
            place = self.place[t]
            rare = place < 0
            q = np.zeros((len(some), len(self.often) + len(self.top)))
            q[of[~rare], place[~rare]] = w[~rare]
            base = q[:, :len(self.often)].astype(np.float32) @ self.often
            tops = q[:, len(self.often):].astype(np.float32) @ self.top
            t, w, size = t[rare], w[rare], np.bincount(of[rare], minlength=len(some))
            starts = np.concatenate([[0], np.cumsum(size)]).tolist()
            for a in range(0, len(some), TOGETHER):
                few = slice(a, min(a + TOGETHER, len(some)))
                terms = slice(starts[few.start], starts[few.stop])
                of, e, s = self._search(base[few], tops[few], q[few], t[terms], w[terms], size[few], k, own[few])
                of, e, s = of[s > 0], e[s > 0], s[s > 0]
                best = np.lexsort((e, -np.round(s, 9), of))
                end = np.cumsum(np.bincount(of, minlength=few.stop - a)).tolist()
                for first, last in zip([0, *end], end):
                    found = best[first:min(last, first + k)]
                    yield e[found], s[found]
            del base, tops, q

    def nearest(self, v: dict[int, float], k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        q = np.array(list(v), dtype=np.int64), np.array(list(v.values()), dtype=np.float64)
        return next(self.nearest_of([q], k, [without]))

    def votes_of(self, queries: Iterable[Vector], k: int, without: Iterable[int] | None = None, batch: int = QUERIES) -> Iterator[float]:
        return (self.vote(e, s) for e, s in self.nearest_of(queries, k, without, batch))

    def vote(self, examples: np.ndarray, cosines: np.ndarray) -> float:
        """Distance-weighted share of toxic votes, the prior's included; -1 without neighbours."""
        if not len(examples):
            return -1.0
        w = 1.0 / (1.1 - np.round(np.minimum(cosines, 1.0), 9))
        prior = PRIOR_MASS * float(self.labels.mean())
        return float(((w * self.labels[examples]).sum() + prior) / (w.sum() + PRIOR_MASS))


@dataclass
class Fitted:
    """The calibrated index: its state on the executors, and the calibration (vote -> score, both rising)."""

    state: Broadcast
    examples: int
    votes: np.ndarray
    scores: np.ndarray
    vectors: DataFrame | None = None  # (row, terms, counts) of all documents, if kept

    def index(self) -> Index:
        """The index itself, built here."""
        return Index.of_state(self.state.value)


def calibrated(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression (pool adjacent violators) of label on vote, smoothed by one prior example: (votes, scores)."""
    prior = (labels.sum() + 0.5) / (len(labels) + 1)
    xs, inverse = np.unique(np.round(votes, 6), return_inverse=True)
    good = np.bincount(inverse, weights=labels, minlength=len(xs))
    n = np.bincount(inverse, minlength=len(xs)).astype(float)
    pools: list[list[float]] = []  # positives, examples, first and last vote
    for x, g, c in zip(xs, good, n):
        pools.append([g, c, x, x])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            g2, c2, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + g2, pools[-1][1] + c2, pools[-1][2], last]
    level = [(g + prior) / (c + 1) for g, c, _, _ in pools]
    level = np.maximum.accumulate(np.array(level)) if level else np.array([prior])
    return np.array([v for p in pools for v in (p[2], p[3])] or [0.0]), np.repeat(level, 2) if pools else level


def scores_of(vote: np.ndarray, votes: np.ndarray, scores: np.ndarray) -> np.ndarray:
    return np.interp(np.round(vote, 6), votes, scores)


def unit(counts: dict[int, int], weights: np.ndarray) -> dict[int, float]:
    t = np.array(sorted(counts), dtype=np.int64)
    v = (1.0 + np.log(np.array([counts[x] for x in t.tolist()], dtype=np.float64))) * weights[t]
    norm = math.sqrt(v @ v)
    return dict(zip(t.tolist(), (v / norm).tolist())) if norm else {}


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per term of a task's examples: how many have it, and how many of those are toxic."""
    have: Counter[bytes] = Counter()
    toxic: Counter[bytes] = Counter()
    for rb in batches:
        for label, text in zip(rb.column(0).to_pylist(), texts_of(rb.column(1))):
            terms = terms_of(text)
            have.update(terms)
            if label:
                toxic.update(terms)
    yield pa.RecordBatch.from_arrays(
        [pa.array(have.keys(), pa.binary()), pa.array(have.values(), pa.int64()),
         pa.array([toxic[w] for w in have], pa.int64())], names=["word", "n", "pos"])


def _once(state: Broadcast, name: str, make):
    """What a worker makes of a broadcast, kept beside it for the worker's later tasks."""
    held = state.value
    if name not in held:
        held[name] = make(held)
    return held[name]


def _doc_frequency(vocabulary: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _once(vocabulary, "names", lambda v: TermIds(v["words"], v["common"]))
        n = np.zeros(len(names.numbers) + 1, dtype=np.int64)  # the last: documents
        for rb in batches:
            for terms, _ in names.counted(texts_of(rb.column(0))):
                n[terms] += 1
            n[-1] += rb.num_rows
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen])], names=["word", "n"])
    return run


def pack_rising(a: np.ndarray) -> bytes:
    """Rising numbers below 2^32 as the byte planes of their steps (the high planes are mostly zero)."""
    return np.ascontiguousarray(np.diff(a, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack_rising(b: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8).reshape(4, -1).T).view("<u4").reshape(-1), dtype=np.int64)


def pack_counts(n: np.ndarray) -> bytes:
    """Numbers from 1 on, as bytes where they fit; the first byte says how wide they are."""
    kind = np.dtype("u1") if n.max(initial=0) < 256 else np.dtype("<u4")
    return bytes([kind.itemsize]) + n.astype(kind).tobytes()


def unpack_counts(b: bytes) -> np.ndarray:
    return np.frombuffer(b, dtype=f"<u{b[0]}", offset=1).astype(np.float64)


def _vectors(vocabulary: Broadcast):
    """The known terms of every text and their counts, packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _once(vocabulary, "names", lambda v: TermIds(v["words"], v["common"]))
        for rb in batches:
            found = list(names.counted(texts_of(rb.column(1))))
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), pa.array([pack_rising(t) for t, _ in found], pa.binary()),
                 pa.array([pack_counts(n) for _, n in found], pa.binary())], names=["row", "terms", "counts"])
    return run


def _vector_frequency(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size + 1, dtype=np.int64)  # the last: documents
        for rb in batches:
            for b in rb.column(0).to_pylist():
                n[unpack_rising(b)] += 1
            n[size] += rb.num_rows
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen])], names=["word", "n"])
    return run


def _counts(vocabulary: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _once(vocabulary, "names", lambda v: TermIds(v["words"], v["common"]))
        for rb in batches:
            found = list(names.counted(texts_of(rb.column(2))))
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), rb.column(1), pa.array([t.astype("<i4").tobytes() for t, _ in found], pa.binary()),
                 pa.array([c.astype("<u4").tobytes() for _, c in found], pa.binary())], names=["id", "label", "terms", "counts"])
    return run


def _own_votes(state: Broadcast, neighbours: int):
    """Votes of examples, each without itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _once(state, "index", Index.of_state)
        for rb in batches:
            e = rb.column(0).to_pylist()
            votes = list(index.votes_of(index.vectors(e), neighbours, e))
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(votes, pa.float64())], names=["id", "vote"])
    return run


def _column_bytes(table: pa.Table, name: str, kind: str) -> np.ndarray:
    """The values of a binary column, one after another, as numbers."""
    return np.frombuffer(b"".join(v.as_buffer() for c in table[name].chunks for v in c), dtype=kind)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, neighbours: int = NEIGHBOURS,
        keep_vectors: bool = False) -> Fitted:
    """The calibrated index; ``labels`` has doc_id and toxic.

    ``keep_vectors`` writes the term counts of all documents to the shared folder on
    the way, so that these documents can be scored without reading their texts again.

    What reaches the driver is bounded by the sample: its terms and its term
    counts, on their way to the executors; the index is built there.

    Defined cases: null ids and null labels are ignored, a repeated label counts as its
    greatest; documents that share a labelled id are examples each; a null or
    empty text is an example without terms; without labels, or documents, the
    index is empty and every score 0.5; other columns are not read.
    """
    spark = docs.sparkSession
    chosen = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 1))
              .groupBy(F.col("doc_id").cast("bigint").alias("l_id")).agg(F.max("toxic").cast("int").alias("label"))
              .orderBy(F.xxhash64("l_id"), "l_id").limit(sample))
    examples = stored(docs.select(F.col("doc_id").cast("bigint").alias("id"), "text")
                      .join(F.broadcast(chosen), F.col("id") == F.col("l_id")).select("id", "label", "text"), "tox-examples")
    total, toxic = examples.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    found = (text_rows(examples, "label", "text").mapInArrow(releasing(_example_terms), "word binary, n bigint, pos bigint")
             .groupBy("word").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).toArrow().sort_by("word"))
    n, pos = (found[c].to_numpy().astype(float) for c in ("n", "pos"))
    words = b"\n".join(found["word"].to_pylist())
    del found
    common = np.argsort(-n, kind="stable")[:COMMON]
    vocabulary = spark.sparkContext.broadcast({"words": words, "common": common})
    chi2 = ((pos * (total - toxic) - (n - pos) * toxic) ** 2 * total
            / (float(max(1, toxic * (total - toxic))) * n * np.maximum(total - n, 1.0)))
    df = np.zeros(len(n) + 1)
    vectors = None
    if keep_vectors:
        kind = docs.schema["doc_id"].dataType.simpleString()
        vectors = stored(text_rows(docs, "doc_id", "text").mapInArrow(
            releasing(_vectors(vocabulary)), f"row {kind}, terms binary, counts binary"), "tox-vectors")
        counted = vectors.select("terms").mapInArrow(releasing(_vector_frequency(len(n))), "word bigint, n bigint")
    else:
        counted = text_rows(docs, "text").mapInArrow(releasing(_doc_frequency(vocabulary)), "word bigint, n bigint")
    counted = counted.groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    df[counted["word"].to_numpy()] = counted["n"].to_numpy()
    del counted
    weights = (np.log((1.0 + df[-1]) / (1.0 + df[:-1])) + 1.0) * (1.0 + np.sqrt(chi2))
    rows = text_rows(examples, "id", "label", "text").mapInArrow(
        releasing(_counts(vocabulary)), "id bigint, label int, terms binary, counts binary").toArrow()
    rows = rows.sort_by([("id", "ascending"), ("terms", "ascending"), ("counts", "ascending")])
    known = {"words": words, "common": common, "weights": weights, "ids": rows["id"].to_numpy(), "labels": rows["label"].to_numpy(),
             "sizes": pa.compute.binary_length(rows["terms"]).to_numpy() // 4, "terms": _column_bytes(rows, "terms", "<i4")}
    counts = _column_bytes(rows, "counts", "<u4")
    known["counts"] = counts.astype(np.min_scalar_type(int(counts.max(initial=0))))
    labels_of, size = known["labels"].copy(), rows.num_rows
    del rows, counts
    state = spark.sparkContext.broadcast(known)
    del known
    vocabulary.unpersist()
    own = spark.range(0, size, 1, task_count(spark)).mapInArrow(
        releasing(_own_votes(state, neighbours)), "id bigint, vote double").toArrow().sort_by("id")
    return Fitted(state, size, *calibrated(own["vote"].to_numpy(), labels_of), vectors)


_SCORES = "row {id}, score double, predicted int, evidence array<struct<doc_id:bigint,similarity:double,toxic:int>>"


def _score(fitted: Fitted, neighbours: int, threshold: float, counted: bool):
    """Scores of texts, or of counted terms."""
    state, votes, scores = fitted.state, fitted.votes, fitted.scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _once(state, "index", Index.of_state)
        for rb in batches:
            if counted:
                pairs = zip(rb.column(1).to_pylist(), rb.column(2).to_pylist())
                queries = (index.weighted(unpack_rising(t), unpack_counts(n)) for t, n in pairs)
            else:
                queries = index.vectors_of(texts_of(rb.column(1)))
            vote, size, near, similar = [], [], [], []
            for e, c in index.nearest_of(queries, neighbours, batch=QUERIES if counted else TEXTS):
                vote.append(index.vote(e, c))
                near.append(e[:EVIDENCE])
                similar.append(c[:EVIDENCE])
                size.append(len(near[-1]))
            near, similar = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (near, similar))
            near = near.astype(np.int64)
            evidence = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()),
                pa.StructArray.from_arrays([pa.array(index.ids[near]), pa.array(similar, pa.float64()), pa.array(index.labels[near], pa.int32())],
                                           names=["doc_id", "similarity", "toxic"]))
            score = scores_of(np.array(vote), votes, scores)
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), pa.array(score), pa.array(score >= threshold).cast(pa.int32()), evidence],
                names=["row", "score", "predicted", "evidence"])
    return run


def scored_vectors(fitted: Fitted, neighbours: int = NEIGHBOURS, threshold: float = THRESHOLD) -> DataFrame:
    """As ``scored``, for the documents of the fit, whose vectors were kept."""
    kind = fitted.vectors.schema["row"].dataType.simpleString()
    return text_rows(fitted.vectors, "*").mapInArrow(
        releasing(_score(fitted, neighbours, threshold, True)), _SCORES.format(id=kind)).withColumnRenamed("row", "doc_id")


def scored(docs: DataFrame, index: Fitted, neighbours: int = NEIGHBOURS, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, score, predicted, evidence.

    Defined cases: a text without a term of any example (null and empty ones too) has
    no neighbours and gets the calibrated rate of such examples; without any
    labelled row every score is 0.5; repeated rows score alike; a null id is a
    row like any other; empty tables give no rows; other columns are not read.
    """
    return text_rows(docs, F.col("doc_id").alias("row"), "text").mapInArrow(
        releasing(_score(index, neighbours, threshold, False)),
        _SCORES.format(id=docs.schema["doc_id"].dataType.simpleString())).withColumnRenamed("row", "doc_id")


def _accept(fitted: Fitted, neighbours: int, threshold: float, at: int):
    state, known, scores = fitted.state, fitted.votes, fitted.scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _once(state, "index", Index.of_state)
        for rb in batches:
            votes = index.votes_of(index.vectors_of(texts_of(rb.column(at))), neighbours, batch=TEXTS)
            keep = scores_of(np.fromiter(votes, dtype=np.float64, count=rb.num_rows), known, scores) < threshold
            yield rb.filter(pa.array(keep, pa.bool_()))
    return run


def accepted(docs: DataFrame, index: Fitted, neighbours: int = NEIGHBOURS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows (same columns) whose score is below the threshold, in one pass without a join.

    Defined cases: as ``scored``; a row of any id, null included, stays or goes by its text alone,
    so repeated rows share their fate; other columns, whatever their names, pass through.
    """
    accept = _accept(index, neighbours, threshold, docs.columns.index("text"))
    return text_rows(docs, "*").mapInArrow(releasing(accept), docs.schema)
