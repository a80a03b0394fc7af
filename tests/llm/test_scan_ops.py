"""URL rules, periodic runs and whitening, held against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import periodic_runs, queries, url_filter, whitening
from tests.conftest import SF
from tests.llm.test_free_ops import docs, sha, space_words

# ---- URL filter --------------------------------------------------------------------------------

PAGES = "page_id long, url string, host int, path long, rule int, kind string, `key` int, `range` int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, 1, 2, 3, "x", 4, 5) for i, u in rows], PAGES)


def plain_judge(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = path[:min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    fit = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules
           if None not in (v, h, p) and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit) if fit else (0, 0, 0, None, default)
    return host, path, best[3], best[4]


def judge(spark, rows, rules, **kw):
    frame = spark.createDataFrame(rules, "verdict string, host string, path string")
    got = url_filter.judged(pages(spark, rows), frame, **kw)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    return sorted(map(str, map(tuple, got.collect())))


def want_judge(rows, rules, **kw):
    return sorted(str((i, *plain_judge(u, rules, **kw))) for i, u in rows)


def test_url_rules_equal_brute_force(spark):
    r = random.Random(3)
    labels, parts = ["a", "b", "com", "", "a-b", "é"], ["x", "xy", "x/y", "", "z"]
    host = lambda: ".".join(r.choice(labels) for _ in range(r.randrange(1, 5)))
    path = lambda: "/" + "/".join(r.choice(parts) for _ in range(r.randrange(0, 4)))
    rows = [(i, f"http://{host().upper() if i % 3 else host()}{path() if i % 5 else ''}{r.choice(['', '?q=/x', '#x', '?'])}")
            for i in range(600)]
    rules = [(r.choice(["allow", "block"]), host(), r.choice(["", "/", path()])) for _ in range(120)]
    for some in (rules, rules[:7], url_filter.RULES):
        assert judge(spark, rows, some) == want_judge(rows, some)


def test_url_special_cases(spark):
    rows = [(1, None), (1, None), (None, "http://Example.COM/en/1"), (2, "no scheme.com/"), (3, "https://"), (4, "x://com"),
            (5, "http://www.example.com/en/a?b"), (6, "http://notexample.com/en/"), (7, "http://a.example.com:80/en/"),
            (8, "http://example.com/en/" + "a" * 100_000), (9, "a://b://com/x"), (10, "http://h\n.com/\n?x"), (11, "")]
    assert judge(spark, rows, url_filter.RULES) == want_judge(rows, url_filter.RULES)
    assert judge(spark, rows, url_filter.RULES, default="block") == want_judge(rows, url_filter.RULES, default="block")
    odd = [("block", "com", "/"), ("allow", "com", "/"), ("allow", None, "/"), ("block", "com", None), (None, "com", "/x"),
           ("block", "", ""), ("allow", "EXAMPLE.com", "/")]
    lowered = [(v, h and h.lower(), p) for v, h, p in odd]
    assert judge(spark, rows, odd) == want_judge(rows, lowered)
    assert judge(spark, rows, []) == want_judge(rows, [])
    assert judge(spark, [], url_filter.RULES) == []


def test_one_address_spreads_over_ranges(spark):
    same = spark.range(4000).select(F.col("id").alias("page_id"), F.lit("http://a.example.com/en/x").alias("url"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    try:
        got = url_filter.judged(same, url_filter.rules_frame(spark))
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(sizes) == 4000 and max(sizes) < 1500
    assert {(r.rule, r.verdict) for r in got.select("rule", "verdict").distinct().collect()} == {("example.com/en/", "block")}


# ---- periodic runs -----------------------------------------------------------------------------

def plain_runs(s, exponent=4, least=6):
    n, out = len(s), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if s[i] != s[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            a, b = i, j + q
            if b - a >= max(least, exponent * q) and not any(s[a:b - d] == s[a + d:b] for d in range(1, q)):
                out.add((a, b - a, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_document(doc_id, text):
    w = space_words(text)
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(w), h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_equal_brute_force():
    r = random.Random(1)
    for _ in range(800):
        k, n = r.choice([1, 2, 3, 4]), r.randrange(0, 60)
        s = [r.randrange(k) for _ in range(n)]
        if r.random() < 0.5 and n > 4:
            a = r.randrange(n)
            p = r.randrange(1, max(2, (n - a) // 3 + 1))
            s = [s[i] if i < a else s[a + (i - a) % p] for i in range(n)]
        for exponent, least in ((4, 6), (2, 2)):
            assert periodic_runs.runs_of(np.array(s), exponent, least) == plain_runs(s, exponent, least), s


def test_longest_common_extensions():
    r = random.Random(5)
    s = [r.randrange(1, 3) for _ in range(200)]
    tree = periodic_runs.SuffixTree(s)
    depths, place, order = tree.tour()
    assert order == sorted(range(201), key=lambda i: s[i:])
    assert tree.opposite_order() == sorted(range(201), key=lambda i: [-c for c in s[i:]])
    i, j = np.array([(a, b) for a in range(200) for b in range(200) if a != b]).T
    got = periodic_runs.Extensions(depths, place).of(i, j)
    for a, b, m in zip(i.tolist(), j.tolist(), got.tolist()):
        assert s[a:a + m] == s[b:b + m] and (max(a, b) + m == 200 or s[a + m] != s[b + m])


def test_collapsed_documents_equal_brute_force(spark):
    r = random.Random(2)
    rows = []
    for i in range(300):
        w = [r.choice("ab" if i % 3 else "abcdefgh") for _ in range(r.randrange(0, 90))]
        if i % 4 == 0:
            w += (["x", "y", "z"][:1 + i % 3] * 9) + w[:5]
        rows.append((i, r.choice([" ", "\n", "\t \x0b"]).join(w)))
    rows += [(None, "a " * 20), (None, None), (301, None), (301, ""), (302, " \n"), (303, "a\u00a0 a\u00a0 " * 9), (7, "b b b b b b b"),
             (7, "b b b b b b b"), (304, "word " * 5), (305, "a b " * 20_000)]
    got = periodic_runs.periodic_runs(docs(spark, rows), planted=True)
    cols = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    short = [x for x in rows if x[0] != 305]
    seen = sorted(str(tuple(x[c] for c in cols)) for x in got.collect() if x.doc_id != 305)
    assert seen == sorted(str(plain_document(*x)) for x in short)
    assert [(x.start, x.length, x.period) for x in got.collect() if x.doc_id == 305] == [(0, 40_000, 2)]
    plain = periodic_runs.periodic_runs(docs(spark, [(20, "a b c d e f g h")])).first()  # 20 would get a tail
    assert plain.collapsed_sha256 == sha("a b c d e f g h") and plain.runs == []
    assert periodic_runs.periodic_runs(docs(spark, [])).count() == 0


def test_query_of_runs_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text or "") < 3000]
    want = {str(plain_document(*x)) for x in rows}
    got = queries.op12_periodic_runs(spark, SF)
    seen = {str(tuple(r)) for r in got.collect()}
    assert want <= seen and got.columns[0] == "doc_id" and sum(r.n_runs > 0 for r in got.collect()) > 5


# ---- whitening ---------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, n int, component string, `X` int, d int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "c", 2, 3) for i, v in rows], VECTORS)


def plain_whitening(rows, k=4):
    kept = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in rows
            if v is not None and len(v) and all(c is not None and np.isfinite(np.float32(c)) for c in v)]
    sizes = [len(x) for x in {tuple(x) for _, x in kept}]
    d = min(set(sizes), key=lambda z: (-sizes.count(z), z))
    kept = [(i, x) for i, x in kept if len(x) == d]
    fit = np.array(sorted({tuple(x) for _, x in kept}), dtype=float)
    n, mean = len(fit), fit.mean(axis=0)
    cov = (fit - mean).T @ (fit - mean) / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    sums = [int(c) for c in fit.sum(axis=0)]
    return [(i, j + 1, n, sum((n * a - b) ** 2 for a, b in zip(x, sums)), float((np.array(x) - mean) @ v[:, j] / np.sqrt(e[j])),
             e[j] / np.trace(cov)) for i, x in kept for j in range(len(e)) if e[j] > 1e-12 * np.trace(cov)]


def check_whitening(got, want):
    assert len(got) == len(want)
    key = lambda r: (r[1], r[0] is None, r[0] or 0, r[3], abs(r[4]))
    got = sorted(((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got), key=key)
    want = sorted(want, key=key)
    for g, w in zip(got, want):
        assert g[:4] == w[:4] and abs(g[5] - w[5]) < 1e-10 and g[6] < 1e-9
    for c in {w[1] for w in want}:
        a, b = (np.array([r[4] for r in x if r[1] == c]) for x in (got, want))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7


def test_whitening_equals_dense_eigenvectors(spark):
    r = np.random.default_rng(4)
    base = r.standard_normal((200, 7)) * [5, 3, 2, 1.5, 1, 0.5, 0.1] @ np.linalg.qr(r.standard_normal((7, 7)))[0] + 40
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    odd = [(None, rows[3][1]), (3, rows[3][1]), (900, None), (901, [None, 1.0] + [0.0] * 5), (902, [float("nan")] * 7),
           (903, [float("inf")] + [0.0] * 6), (904, []), (905, [1.0, 2.0]), (906, rows[5][1])] + [(1000 + i, rows[0][1]) for i in range(60)]
    check_whitening(whitening.whitened(vectors(spark, rows + odd)).collect(), plain_whitening(rows + odd))


def test_whitening_without_variance(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        got = whitening.whitened(vectors(spark, rows))
        assert got.collect() == [] and got.columns[0] == "vec_id"
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)]  # one component only
    check_whitening(whitening.whitened(vectors(spark, line)).collect(), plain_whitening(line))
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert all(r.deviation is None or r.deviation >= 0 for r in whitening.whitened(huge).collect())


@pytest.mark.parametrize("seed,d", [(1, 1), (2, 2), (3, 12), (4, 40), (5, 64)])
def test_feast_equals_dense_eigenvalues(seed, d):
    r = np.random.default_rng(seed)
    q = np.linalg.qr(r.standard_normal((d, d)))[0]
    for spectrum in (r.random(d) ** 2, np.ones(d), np.linspace(1, 1.01, d), np.r_[np.full(d // 2, 3.0), np.full(d - d // 2, 1e-9)]):
        a = q * spectrum @ q.T
        a = (a + a.T) / 2
        values, v = whitening.components(a)
        want = np.sort(spectrum)[::-1][:4]
        assert len(values) == len(want) and np.allclose(values, want, rtol=1e-9, atol=1e-12)
        assert np.allclose(v.T @ v, np.eye(len(values)), atol=1e-10) and np.allclose(a @ v, v * values, atol=1e-10)


def test_inertia_counts_eigenvalues():
    r = np.random.default_rng(9)
    a = r.standard_normal((30, 30))
    a = a + a.T
    e = np.linalg.eigvalsh(a)
    form = whitening.tridiagonal(a)
    assert np.allclose(np.linalg.eigvalsh(np.diag(form[0]) + np.diag(form[1], 1) + np.diag(form[1], -1)), e)
    assert all(whitening.above(form, s) == int((e > s).sum()) for s in np.linspace(-20, 20, 81))


def test_query_of_whitening_equals_dense_eigenvectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(queries.op13_whitening(spark, SF).collect(), plain_whitening(rows))


def test_packed_vectors_round_trip():
    import pyarrow as pa
    for x in ([0, -1, 127], [128, 0, 0], [-40_000, 1, 2], [2**62, -5, 0]):
        x = np.array(x)
        assert (whitening.unpack_vectors(pa.array([whitening.pack_vector(x)] * 2), 3) == x).all()
    assert hashlib.sha256(whitening.pack_vector(np.array([1, 2]))).digest() != hashlib.sha256(whitening.pack_vector(np.array([1, 300]))).digest()
