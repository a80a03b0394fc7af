"""Embedding whitening with components from FEAST contour integration.

1. Vectors become integers (256 times each entry, floored) and travel packed; the
   fit list has each distinct vector once (a hash aggregate on the packed bytes, so
   copies of a vector are combined before the shuffle).
2. Spark sums the fit list per dimension, exactly, then the products of the
   centred vectors.  What reaches the driver is one sum per dimension and one
   per pair of dimensions.
3. An interval that holds the wanted eigenvalues, found by inertia counts (sign
   changes of the Sturm sequence of the Householder tridiagonal form, one count a
   shift).  FEAST projects a random block onto its eigenvectors: a quadrature of the
   contour around the interval, one complex shifted solve per node; Rayleigh-Ritz
   extracts the components, until their residuals vanish.  The inertia of the
   interval must equal the number of components found, so none is missed.
4. Every remaining row is projected; the covariance of the projected fit list is
   measured by another pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored, text_rows
from tessera.llm.grams import releasing

SCALE = 256
COMPONENTS = 4
NODES = 16  # of the quadrature on the half circle
ROUNDS = 40
RESIDUAL = 1e-14  # relative to the largest eigenvalue and the dimensions
FLAT = 1e-12  # eigenvalues below this share of the trace have no component
SCHEMA = "vec_id {id}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"

_WIDTHS = [np.dtype(t) for t in ("<i1", "<i2", "<i4", "<i8")]


# ---- integer vectors ---------------------------------------------------------------------------

def integer_rows(column: pa.Array) -> list[np.ndarray | None]:
    """The integer vector of each row; None where the vector, or an entry of it, is null or not finite.

    Entries beyond the range of a long take its nearest end.
    """
    entry = column.type.value_type
    flat = column.values
    bad = np.asarray(flat.is_null())
    v = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False) if not pa.types.is_null(entry) else np.zeros(len(flat))
    bad = bad | ~np.isfinite(v)
    with np.errstate(over="ignore"):
        x = np.floor(np.where(bad, 0.0, v) * SCALE)
    top = np.iinfo(np.int64).max
    whole = np.where(np.abs(x) < 2.0**63, x, 0.0).astype(np.int64)
    whole[x >= 2.0**63] = top
    whole[x <= -(2.0**63)] = -top - 1
    wrong = np.concatenate([[0], np.cumsum(bad)])
    at = column.offsets.to_numpy()
    valid = np.asarray(column.is_valid())
    return [whole[a:b] if ok and wrong[a] == wrong[b] else None for a, b, ok in zip(at[:-1], at[1:], valid)]


def pack_vector(x: np.ndarray) -> bytes:
    """Equal vectors have equal bytes: the narrowest integers that hold the vector, behind their width."""
    lo, hi = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    width = next(w for w in _WIDTHS if np.iinfo(w).min <= lo and hi <= np.iinfo(w).max)
    return bytes([width.itemsize]) + x.astype(width).tobytes()


def unpack_vectors(packed: pa.Array, d: int) -> np.ndarray:
    """Packed vectors of ``d`` entries as the rows of a matrix; rows of one width come together."""
    raw = packed.to_pylist()
    parts = []
    for w in _WIDTHS:
        some = b"".join(b for b in raw if b[0] == w.itemsize)
        if some:
            cells = np.frombuffer(some, dtype=np.uint8).reshape(-1, 1 + d * w.itemsize)[:, 1:]
            parts.append(np.ascontiguousarray(cells).view(w).astype(np.int64))
    return np.concatenate(parts) if parts else np.empty((0, d), dtype=np.int64)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        found = [x for x in integer_rows(rb.column(0)) if x is not None and len(x)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([len(x) for x in found], pa.int32()), pa.array([pack_vector(x) for x in found], pa.binary())],
            names=["d", "x"])


def fit_list(vectors: DataFrame) -> DataFrame:
    """(d, x): each distinct remaining vector once, packed, with its dimensions; stored."""
    packed = text_rows(vectors, "embedding").mapInArrow(releasing(_pack), "d int, x binary")
    return stored(packed.distinct(), "whiten-fit")


# ---- sums over the fit list ---------------------------------------------------------------------

def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task: per number of dimensions, vectors and their exact sums."""
    total: dict[int, list] = {}
    for rb in batches:
        dims = rb.column(0).to_numpy()
        for d in np.unique(dims).tolist():
            x = unpack_vectors(rb.column(1).filter(pa.array(dims == d)), d)
            small = float(np.abs(x.astype(float)).max()) * len(x) < 2.0**62
            s = x.sum(axis=0).tolist() if small else [sum(c) for c in zip(*x.tolist())]
            n, before = total.get(d, (0, [0] * d))
            total[d] = n + len(x), [a + c for a, c in zip(before, s)]
    for d, (n, s) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()),
                                          pa.array(map(str, s), pa.string())], names=["d", "i", "n", "s"])


def totals(fit: DataFrame) -> tuple[int, int, list[int]]:
    """(dimensions, n, S) of the fit list; of several numbers of dimensions the most frequent, then the smallest."""
    found = (fit.select("d", "x").mapInArrow(releasing(_sums), "d int, i int, n bigint, s string")
             .groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s")))
    counted = found.filter("i = 0").orderBy(F.desc("n"), "d").first()
    if counted is None:
        return 0, 0, []
    rows = found.filter(F.col("d") == counted.d).orderBy("i").collect()
    return counted.d, counted.n, [int(r.s) for r in rows]


def _products(mean: np.ndarray, project: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One task: the sums of products of the centred, and maybe projected, vectors (upper triangle)."""
        total = None
        for rb in batches:
            y = unpack_vectors(rb.column(0), len(mean)) - mean
            y = y if project is None else y @ project
            total = y.T @ y + (0.0 if total is None else total)
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])],
                                             names=["i", "j", "v"])
    return run


def covariance(fit: DataFrame, d: int, n: int, sums: list[int], project: np.ndarray | None = None) -> np.ndarray:
    """Covariance of the fit list (divisor n), or of its centred vectors times ``project``."""
    mean = np.array([s / n for s in sums])
    got = (fit.filter(F.col("d") == d).select("x").mapInArrow(releasing(_products(mean, project)), "i int, j int, v double")
           .groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow())
    out = np.zeros((d, d) if project is None else (project.shape[1],) * 2)
    out[got["i"].to_numpy(), got["j"].to_numpy()] = got["v"].to_numpy() / n
    return np.triu(out) + np.triu(out, 1).T


# ---- eigenvalues by counting, components by contour integration -----------------------------------

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a symmetric matrix after Householder reflections."""
    a = a.copy()
    n = len(a)
    for k in range(n - 2):
        v = a[k + 1:, k].copy()
        norm = np.linalg.norm(v)
        if norm == 0.0:
            continue
        v[0] += norm if v[0] >= 0 else -norm
        v /= np.linalg.norm(v)
        b = a[k + 1:, k + 1:]
        p = b @ v
        w = p - (v @ p) * v
        b -= 2.0 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1:, k] -= 2.0 * v * (v @ a[k + 1:, k])
    return np.diag(a).copy(), np.diag(a, -1).copy()


def above(form: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """Inertia: how many eigenvalues of the matrix with this tridiagonal form exceed the shift."""
    diagonal, off = form
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    count, q = 0, 1.0
    for i, a in enumerate(diagonal.tolist()):
        q = a - shift - (off[i - 1] ** 2 / q if i else 0.0)
        if abs(q) < tiny:
            q = -tiny
        count += q > 0
    return count


def eigenvalue(form: tuple[np.ndarray, np.ndarray], k: int, lo: float, hi: float) -> float:
    """The k-th largest eigenvalue (from 1) by bisection on inertia counts."""
    exact = 4 * np.finfo(float).eps * max(abs(lo), abs(hi))
    while hi - lo > exact:
        mid = 0.5 * (lo + hi)
        if above(form, mid) >= k:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


def feast(a: np.ndarray, lo: float, hi: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of a symmetric matrix inside (lo, hi), largest first."""
    d = len(a)
    size = min(d, 2 * count + 4)
    theta, weight = np.polynomial.legendre.leggauss(NODES)
    angle = 0.5 * np.pi * (theta + 1.0)
    centre, radius = 0.5 * (lo + hi), 0.5 * (hi - lo)
    nodes = centre + radius * np.exp(1j * angle)
    scale = max(abs(lo), abs(hi))
    block = np.linalg.qr(np.random.default_rng(1).standard_normal((d, size)))[0]
    best = None
    for _ in range(ROUNDS):
        moved = np.zeros((d, size))
        for z, t, w in zip(nodes, angle, weight):  # the lower half of the contour is the conjugate
            moved += 0.5 * w * radius * np.real(np.exp(1j * t) * np.linalg.solve(z * np.eye(d) - a, block.astype(complex)))
        q = np.linalg.qr(moved)[0]
        values, small = np.linalg.eigh(q.T @ a @ q)
        block = q @ small
        inside = np.flatnonzero((values > lo) & (values < hi))[::-1]
        if len(inside) != count:
            continue
        v = block[:, inside]
        worst = np.abs(a @ v - v * values[inside]).max()
        if best is None or worst < best[0]:
            best = worst, values[inside], v
        elif best[0] <= scale * d * RESIDUAL * 10:
            break  # as exact as the arithmetic allows
        if worst <= scale * RESIDUAL:
            break
    if best is None or best[0] > 1e-9 * scale:
        raise ArithmeticError(f"no {count} eigenvectors between {lo} and {hi}")
    return best[1], best[2] / np.linalg.norm(best[2], axis=0)


def components(cov: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``wanted`` largest eigenvalues and unit eigenvectors (as columns), largest first.

    Fewer where the rest of the eigenvalues is zero but for rounding.
    """
    d, trace = len(cov), float(np.trace(cov))
    if not d or not trace > 0:
        return np.empty(0), np.empty((d, 0))
    form = tridiagonal(cov)
    bound = float(np.abs(cov).sum(axis=1).max())  # no eigenvalue is larger
    top, floor = bound * 1.01, FLAT * trace
    wanted = min(wanted, above(form, floor))
    # end the interval below the wanted ones where the next gap is clear, so that no close group is cut
    m = wanted
    e = [eigenvalue(form, k, -top, top) for k in range(1, m + 1)]
    while True:
        rest = eigenvalue(form, m + 1, -top, top) if m < d else -top
        if e[-1] - max(rest, 0.0) > 1e-3 * e[-1]:
            break
        e.append(rest)
        m += 1
    lo, hi = 0.5 * (e[-1] + max(rest, 0.0)), e[0] + max(0.5 * (e[-1] - max(rest, 0.0)), 1e-3 * e[0])
    inside = above(form, lo) - above(form, hi)
    if inside != m:
        raise ArithmeticError(f"{inside} eigenvalues in an interval of {m}")
    values, vectors = feast(cov, lo, hi, m)
    return values[:wanted], vectors[:, :wanted]


# ---- the operator ---------------------------------------------------------------------------------

@dataclass
class Whitening:
    """A fitted transform: what every row is projected with."""

    dims: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    def project(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n * x - S)^2; None beyond the range of a long."""
        most = 2.0 * self.n * (float(np.abs(x.astype(float)).max(initial=0.0)) + max(map(abs, self.sums), default=0) / self.n + 1.0)
        if most * most * max(1, self.dims) < 2.0**62:
            y = self.n * x - np.array(self.sums, dtype=np.int64)
            return (y * y).sum(axis=1).tolist()
        exact = [sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums)) for row in x]
        return [v if v < 1 << 63 else None for v in exact]


def fit(vectors: DataFrame, wanted: int = COMPONENTS) -> Whitening:
    """The transform of a table of vectors (column embedding).

    The driver holds the covariance and its components only, which grow with
    the square of the dimensions and not with the rows.
    """
    distinct = fit_list(vectors)
    d, n, sums = totals(distinct)
    cov = covariance(distinct, d, n, sums) if n else np.zeros((0, 0))
    values, basis = components(cov, wanted)
    out = Whitening(d, n, sums, values, basis, float(np.trace(cov)), 0.0)
    if len(values):
        white = covariance(distinct, d, n, sums, out.project())
        out.identity_error = float(np.abs(white - np.eye(len(values))).max())
    return out


def _whiten(w: Whitening) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(w.values)
        mean, project = np.array([s / w.n for s in w.sums]), w.project()
        for rb in batches:
            found = integer_rows(rb.column(1))
            at = [i for i, x in enumerate(found) if x is not None and len(x) == w.dims]
            if not at:
                continue
            x = np.stack([found[i] for i in at])
            ids = rb.column(0).take(pa.array(np.repeat(at, k)))
            m = len(ids)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()), pa.array(np.full(m, w.n), pa.int64()),
                 pa.array([v for v in w.deviation(x) for _ in range(k)], pa.int64()),
                 pa.array(((x - mean) @ project).reshape(-1)), pa.array(np.tile(w.values / w.trace, len(at))),
                 pa.array(np.full(m, w.identity_error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whitened(vectors: DataFrame, transform: Whitening | None = None, wanted: int = COMPONENTS) -> DataFrame:
    """Per remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Defined cases: rows whose vector is null or empty, or holds a null or
    non-finite entry, go; so do those of other than the most frequent number of
    dimensions of the distinct vectors (ties: the smaller); components without
    variance are not returned, so equal vectors, or a single one, give no rows;
    equal eigenvalues give some orthogonal choice of components, the same for
    all rows; a deviation beyond the range of a long is null; a null id
    is an id like any other; repeated rows are each returned; empty tables give no
    rows; other columns are not read.
    """
    spark = vectors.sparkSession
    schema = SCHEMA.format(id=vectors.schema["vec_id"].dataType.simpleString())
    transform = fit(vectors, wanted) if transform is None else transform
    if not len(transform.values):
        return spark.createDataFrame([], schema)
    return text_rows(vectors, "vec_id", "embedding").mapInArrow(releasing(_whiten(transform)), schema)
