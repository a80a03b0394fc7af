"""N-gram Jaccard join with rare-first prefix filtering.

1. Each task takes the set of 5-word shingles of its documents; documents with
   the same set form a class (128-bit digest of the set).  The shingle hashes
   are shuffled by value as packed blobs; a bucket counts how many classes hold
   each.  A shingle that one batch alone finds in ``FREQUENT`` classes sends a
   count instead of its documents, so a passage in a third of all documents
   sends at most ``FREQUENT`` entries per batch.  Only shingles in at least two
   classes go back; a class keeps (hash, count) of those and the size of its set.
2. All classes order their shingles by (count up to FREQUENT, hash): shingles of
   one class come first and can never match, so they only shorten the prefix.
   Classes whose shared shingles are too few for any partner drop out here
   (the positional bound at the first shared shingle).
3. Classes meet on the n-grams of their prefixes.  Not all pairs of a bucket are
   made: first everyone meets the bucket's hub, which yields links and exact
   overlaps.  Pairs inside one component need no further test.  Pairs that
   cross components are joined from the smaller side (classes not linked to the
   hub against the bucket) under length, positional and prefix-role bounds and
   a bound from both classes' overlaps with the hub.
4. Each distinct pair is verified once: a suffix filter (partition counts of the
   sets bound the overlap), then the exact intersection.

The result keeps every document: its class, its set size and the smallest id
of its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import grams as G
from tessera.llm.common import stored, task_count, text_rows
from tessera.llm.components import components

SHINGLE = 5
SIMILARITY = (75, 100)
FREQUENT = 64
_BLOB = "bucket int, batch long, kind int, payload binary"
_DOCS, _SHARED, _ENTRIES = 1, 0, 2


def shingle_set(w: np.ndarray, rolling: G.Rolling) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a document's word hashes."""
    if not len(w):
        return w
    if len(w) < rolling.width:  # the whole sequence as one shingle
        return np.array([xxhash.xxh3_64_intdigest(w.tobytes(), seed=len(w))], dtype=np.uint64)
    return np.unique(rolling.hashes(w))


def _to_arrow(rows) -> Iterator[pa.RecordBatch]:
    for row in rows:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(
            row, (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names=["bucket", "batch", "kind", "payload"])


def _batch_rows(batch: int, ids: list, keys: list, nodes: list[bytes], sizes: list, sets: dict, buckets: int):
    """Rows of one batch: its documents, and the shingle entries of its classes."""
    names = list(sets)
    where = {n: i for i, n in enumerate(names)}
    isnull = np.array([i is None for i in ids], dtype=bool)
    yield batch % buckets, batch, _DOCS, G.join_parts([
        G.pack_signed(np.array([i or 0 for i in ids], dtype=np.int64)), np.packbits(isnull).tobytes(),
        np.array(keys, dtype="<i8").tobytes(), np.array([where.get(n, -1) for n in nodes], dtype="<i4").tobytes(),
        G.pack_ints(np.array(sizes)), b"".join(names), G.pack_ints(np.array([len(sets[n]) for n in names]))])
    if not names:
        return
    lens = np.array([len(s) for s in sets.values()], dtype=np.int64)
    h = np.concatenate(list(sets.values()))
    own = np.repeat(np.arange(len(names)), lens)
    order = np.argsort(h, kind="stable")
    start = np.flatnonzero(G.group_starts(h[order]))
    count = np.diff(np.append(start, len(h)))
    often = np.zeros(len(h), dtype=bool)
    often[order] = np.repeat(count >= FREQUENT, count)
    common = np.sort(h[order[start[count >= FREQUENT]]])
    if len(common):  # these are settled here
        yield batch % buckets, batch, _SHARED, _shared_payload(
            own[often], _tokens(h[often] >> np.uint64(8), h[often] % np.uint64(buckets)),
            np.full(int(often.sum()), FREQUENT))
    cuts = dict(G.by_bucket(common, buckets))
    h, own = h[~often], own[~often]
    for bucket, at in G.by_bucket(h, buckets):
        yield bucket, batch, _ENTRIES, G.join_parts(
            [*_pack_owners(own[at]), G.pack_hashes(h[at]), G.pack_hashes(common[cuts.pop(bucket, [])])])
    for bucket, at in cuts.items():
        yield bucket, batch, _ENTRIES, G.join_parts([*_pack_owners(own[:0]), b"", G.pack_hashes(common[at])])


def _offsets(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(G.group_starts(own))
    return start, np.diff(np.append(start, len(own)))


def _pack_owners(own: np.ndarray) -> list[bytes]:
    names, counts = np.unique(own, return_counts=True)
    return [G.pack_ints(np.diff(names.astype(np.int64), prepend=0)), G.pack_ints(counts)]


def _unpack_owners(parts: list[bytes]) -> np.ndarray:
    return np.repeat(np.cumsum(G.unpack_ints(parts[0]).astype(np.int64)), G.unpack_ints(parts[1]).astype(np.int64))


def _tokens(upper: np.ndarray, bucket: np.ndarray | int) -> np.ndarray:
    """A 64-bit token from the 56 stored bits of a hash and its bucket."""
    return G.mix(upper | (np.asarray(bucket, dtype=np.uint64) << np.uint64(56)))


def _shared_payload(own: np.ndarray, tokens: np.ndarray, count: np.ndarray) -> bytes:
    """Entries sorted by class: (class, token, count)."""
    return G.join_parts([*_pack_owners(own), tokens.astype("<u8").tobytes(), G.pack_ints(count)])


def _shingle_docs(width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rolling = G.WordHashes(), G.Rolling(width)
        task, limit = TaskContext.get().partitionId() << 24, G.batch_limit(buckets)
        ids, keys, nodes, sizes, sets, n, made = [], [], [], [], {}, 0, 0
        for rb in batches:
            for i, k, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), G.texts_of(rb.column(2))):
                s = shingle_set(words.of((text or b"").lower().split()), rolling)
                node = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b""
                ids.append(i)
                keys.append(k)
                nodes.append(node)
                sizes.append(len(s))
                if len(s) and node not in sets:
                    sets[node] = s
                    n += len(s)
                if n >= limit:
                    yield from _to_arrow(_batch_rows(task + made, ids, keys, nodes, sizes, sets, buckets))
                    ids, keys, nodes, sizes, sets, n, made = [], [], [], [], {}, 0, made + 1
        if ids:
            yield from _to_arrow(_batch_rows(task + made, ids, keys, nodes, sizes, sets, buckets))
    return run


def _count_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: entries of shingles that at least two classes hold, with the count (up to FREQUENT)."""
    hs, owner, which, often, mine = [], [], [], [], 0
    for rb in batches:
        for bucket, batch, kind, payload in zip(*(rb.column(c).to_pylist() for c in range(4))):
            if kind != _ENTRIES:
                yield from _to_arrow([(bucket, batch, kind, payload)])
                continue
            parts = G.split_parts(payload)
            mine = bucket
            hs.append(G.unpack_hashes(parts[2]))
            owner.append(_unpack_owners(parts).astype(np.int32))
            which.append(np.full(len(hs[-1]), batch, dtype=np.int64))
            often.append(G.unpack_hashes(parts[3]))
    if not hs:
        return
    h = np.concatenate(hs)
    del hs
    order = np.argsort(h, kind="stable")
    start = np.flatnonzero(G.group_starts(h[order]))
    count = np.diff(np.append(start, len(h)))
    common = np.unique(np.concatenate(often))
    known = np.isin(h[order[start]], common)
    count = np.where(known, FREQUENT, np.minimum(count, FREQUENT))
    total = np.empty(len(h), dtype=np.int64)
    total[order] = np.repeat(count, np.diff(np.append(start, len(h))))
    del order
    at = np.flatnonzero(total > 1)
    h, total = h[at], total[at]
    own, which = np.concatenate(owner)[at], np.concatenate(which)[at]
    cuts = np.flatnonzero(G.group_starts(which))
    for a, b in zip(cuts, [*cuts[1:], len(which)]):
        yield from _to_arrow([(0, int(which[a]), _SHARED, _shared_payload(
            own[a:b], _tokens(h[a:b], mine), total[a:b]))])


_CLASS = ("doc_id bigint, row_key bigint, node binary, n bigint, hashes binary, counts binary")


def _classes(table: pa.Table) -> pa.Table:
    """One batch: a row for each document; the first document of a class carries its shared shingles."""
    own, hs, cs, head = [], [], [], None
    for kind, payload in zip(table.column("kind").to_pylist(), table.column("payload").to_pylist()):
        parts = G.split_parts(payload)
        if kind == _DOCS:
            head = parts
        else:
            own.append(_unpack_owners(parts))
            hs.append(np.frombuffer(parts[2], dtype="<u8"))
            cs.append(G.unpack_ints(parts[3]).astype(np.uint8))
    ids, keys = G.unpack_signed(head[0]), np.frombuffer(head[2], dtype="<i8")
    isnull = np.unpackbits(np.frombuffer(head[1], dtype=np.uint8))[:len(ids)].astype(bool)
    of, sizes = np.frombuffer(head[3], dtype="<i4"), G.unpack_ints(head[4]).astype(np.int64)
    n_names = len(head[5]) // 16
    names = [head[5][16 * i:16 * i + 16] for i in range(n_names)]
    shared: list = [None] * n_names
    if own:
        o, h, c = np.concatenate(own), np.concatenate(hs), np.concatenate(cs)
        order = np.lexsort((h, c, o))
        o, h, c = o[order], h[order], c[order]
        at, k = _offsets(o)
        for a, m in zip(at, k):
            shared[o[a]] = (h[a:a + m].astype("<u8").tobytes(), c[a:a + m].tobytes())
    out_h, out_c, seen = [], [], set()
    for name in of.tolist():
        first = name >= 0 and name not in seen and shared[name] is not None
        seen.add(name)
        out_h.append(shared[name][0] if first else None)
        out_c.append(shared[name][1] if first else None)
    return pa.table({
        "doc_id": pa.array(ids, pa.int64(), mask=isnull), "row_key": pa.array(keys, pa.int64()),
        "node": pa.array([names[i] if i >= 0 else None for i in of], pa.binary()), "n": pa.array(sizes, pa.int64()),
        "hashes": pa.array(out_h, pa.binary()), "counts": pa.array(out_c, pa.binary())})


def classes(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """Per row: doc_id, row_key, node (class), n (set size); one row per class and batch has its shared shingles."""
    base = text_rows(docs, F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("row_key"), "text")
    k = task_count(docs.sparkSession)
    blobs = base.mapInArrow(G.releasing(_shingle_docs(width, k)), _BLOB)
    counted = blobs.repartitionById(k, F.col("bucket")).mapInArrow(G.releasing(_count_classes), _BLOB)
    return counted.groupBy("batch").applyInArrow(_classes, _CLASS)


def _prefix_rows(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(token, node, n, alone, pos, idx) of the shared shingles in each class's prefix.

        alone: how many shingles only this class has; idx: inside the index prefix.
        """
        for rb in batches:
            cols = ([], [], [], [], [], [])
            for node, n, raw in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), rb.column(2).to_pylist()):
                h = np.frombuffer(raw, dtype="<i8")
                unique = n - len(h)
                probe = n - -(-num * n // den) + 1
                index = n - -(-2 * num * n // (num + den)) + 1
                m = max(0, probe - unique)
                cols[0].append(h[:m])
                cols[1].extend([node] * m)
                cols[2].append(np.full(m, n))
                pos = unique + np.arange(m)
                cols[3].append(pos)
                cols[4].append(pos < index)
                cols[5].append(np.full(m, unique))
            if cols[1]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(cols[0]), pa.int64()), pa.array(cols[1], pa.binary()),
                     pa.array(np.concatenate(cols[2]), pa.int64()), pa.array(np.concatenate(cols[3]), pa.int64()),
                     pa.array(np.concatenate(cols[4]), pa.bool_()), pa.array(np.concatenate(cols[5]), pa.int64())],
                    names=["token", "node", "n", "pos", "idx", "alone"])
    return run


def _verify(num: int, den: int):
    edges = np.arange(1, 16, dtype=np.uint64) << np.uint64(60)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Exact overlap of each pair that passes the suffix filter."""
        for rb in batches:
            u, v, o, linked = [], [], [], []
            for a, b, na, nb, ha, hb in zip(*(rb.column(c).to_pylist() for c in range(6))):
                x, y = np.sort(np.frombuffer(ha, dtype="<u8")), np.sort(np.frombuffer(hb, dtype="<u8"))
                cx = np.diff(np.searchsorted(x, edges), prepend=0, append=len(x))
                cy = np.diff(np.searchsorted(y, edges), prepend=0, append=len(y))
                most = int(np.minimum(cx, cy).sum())
                if den * most < num * (na + nb - most):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                u.append(a)
                v.append(b)
                o.append(both)
                linked.append(den * both >= num * (na + nb - both))
            yield pa.RecordBatch.from_arrays(
                [pa.array(u, pa.binary()), pa.array(v, pa.binary()), pa.array(o, pa.int64()), pa.array(linked, pa.bool_())],
                names=["u", "v", "both", "linked"])
    return run


def _enough(most: Column, a_n: Column, b_n: Column, num: int, den: int) -> Column:
    """Whether an overlap of at most ``most`` can reach the similarity."""
    return most * den >= (a_n + b_n - most) * num


def _bounded(a_n: Column, a_pos: Column, b_n: Column, b_pos: Column, num: int, den: int) -> Column:
    """Length bound, and positional bound at a pair's first common shingle.

    A similar pair passes at its first common shingle, so it is found whatever
    becomes of its other common shingles.
    """
    most = 1 + F.least(a_n - a_pos - 1, b_n - b_pos - 1)
    return (F.least(a_n, b_n) * den >= F.greatest(a_n, b_n) * num) & _enough(most, a_n, b_n, num, den)


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v, both, linked) of distinct pairs; ``pairs`` has u, v, nu, nv and the positions pu, pv of a common shingle."""
    once = (pairs.groupBy("u", "v").agg(F.first("nu").alias("nu"), F.first("nv").alias("nv"),
                                        F.min("pu").alias("pu"), F.min("pv").alias("pv"))
            .filter(_bounded(F.col("nu"), F.col("pu"), F.col("nv"), F.col("pv"), num, den)))
    side = lambda c: sets.select(F.col("node").alias(c), F.col("hashes").alias(f"h{c}"))
    both = once.join(side("v"), "v").join(side("u"), "u")
    return both.select("u", "v", "nu", "nv", "hu", "hv").mapInArrow(
        G.releasing(_verify(num, den)), "u binary, v binary, both bigint, linked boolean")


def _normal(pairs: DataFrame) -> DataFrame:
    """Pairs with the smaller class as u, so that a pair is one whichever side found it."""
    swap = F.col("u") > F.col("v")
    two = lambda a, b: (F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a), F.when(swap, F.col(a)).otherwise(F.col(b)).alias(b))
    return pairs.select(*two("u", "v"), *two("nu", "nv"), *two("pu", "pv"))


def links(sets: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Links (u, v) that connect every pair of classes with Jaccard >= similarity.

    ``sets`` (stored, one row per class): node, n, hashes in (count, hash) order.
    Every pair of similar classes is either linked itself or inside a component
    of links, so components of the result are those of all similar pairs.
    """
    num, den = similarity
    spark = sets.sparkSession
    tokens = stored(sets.select("node", "n", "hashes").mapInArrow(
        G.releasing(_prefix_rows(num, den)), "token bigint, node binary, n bigint, pos bigint, idx boolean, alone bigint"), "jaccard-tokens")
    # the hub is the class with the fewest rare shingles before the token: the one nearest to the others
    hubs = (tokens.groupBy("token").agg(F.min(F.struct("pos", "node", "n")).alias("hub"),
                                        F.count(F.lit(1)).alias("c"))
            .filter(F.col("c") > 1).select(F.col("token").alias("t"), F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"),
                                           F.col("hub.pos").alias("hub_pos")))
    met = tokens.join(hubs, tokens.token == hubs.t).drop("t").filter(F.col("node") != F.col("hub"))
    star = (met.filter(_bounded(F.col("n"), F.col("pos"), F.col("hub_n"), F.col("hub_pos"), num, den))
            .select(F.col("hub").alias("u"), F.col("node").alias("v"), F.col("hub_n").alias("nu"), F.col("n").alias("nv"),
                    F.col("hub_pos").alias("pu"), F.col("pos").alias("pv")))
    near = stored(_verified(_normal(star), sets, num, den), "jaccard-near")
    first = near.filter("linked").select("u", "v")
    comp = stored(components(first), "jaccard-components")
    placed = (met.join(comp.withColumnRenamed("root", "own_root"), "node", "left")
              .join(comp.select(F.col("node").alias("hub"), F.col("root").alias("hub_root")), "hub", "left")
              .withColumns({"u": F.least("hub", "node"), "v": F.greatest("hub", "node")})
              .join(near.select("u", "v", "both"), ["u", "v"], "left")
              .select("token", "node", "n", "pos", "idx", "alone", "both", F.coalesce("own_root", "node").alias("comp"),
                      F.coalesce("hub_root", "hub").alias("hub_comp")))
    placed = stored(placed, "jaccard-placed")
    outside = placed.filter(F.col("comp") != F.col("hub_comp"))
    a, b = outside.alias("a"), placed.alias("b")
    # common shingles are in the hub for both, or outside it for both, and no class's own
    beyond = lambda x: F.col(f"{x}.n") - F.col(f"{x}.alone") - F.col(f"{x}.both")
    by_hub = F.least("a.both", "b.both") + F.least(beyond("a"), beyond("b"))
    hub_bound = by_hub.isNull() | _enough(by_hub, F.col("a.n"), F.col("b.n"), num, den)
    longer = (F.col("a.n") > F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.node") > F.col("b.node")))
    role = F.when(longer, F.col("b.idx")).otherwise(F.col("a.idx"))  # the shorter meets in its index prefix
    once = (F.col("b.comp") == F.col("b.hub_comp")) | (F.col("a.node") < F.col("b.node"))
    cross = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.comp") != F.col("b.comp")) & once & role & hub_bound
                   & _bounded(F.col("a.n"), F.col("a.pos"), F.col("b.n"), F.col("b.pos"), num, den))
    cross = cross.select(F.col("a.node").alias("u"), F.col("b.node").alias("v"), F.col("a.n").alias("nu"),
                         F.col("b.n").alias("nv"), F.col("a.pos").alias("pu"), F.col("b.pos").alias("pv"))
    cross = _normal(cross).join(near.select("u", "v"), ["u", "v"], "left_anti")  # those are verified
    second = _verified(cross, sets, num, den).filter("linked").select("u", "v")
    return first.union(second)


def near_duplicates(docs: DataFrame, width: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Per row: doc_id, row_key, n_shingles, node (class), root (component), component_id.

    Documents link when the Jaccard similarity of their shingle sets is at least
    ``similarity``; component_id is the smallest doc_id reachable by links.

    Defined cases: null, empty or blank text has an empty set, node and root are
    null and it is linked with nothing (component_id is its own id); fewer words
    than a shingle make one shingle of the whole sequence; a null id never is a
    component_id unless all ids of the component are null; rows that share an id
    but not the text are documents of their own; repeated rows are each
    returned; empty tables give no rows; other columns are not read.
    """
    num, den = similarity
    rows = stored(classes(docs, width), "jaccard-classes")
    enough = F.octet_length("counts") * den >= F.col("n") * num  # else no partner can reach the similarity
    sets = stored(rows.filter(F.col("hashes").isNotNull() & enough).groupBy("node")
                  .agg(F.first("n").alias("n"), F.first("hashes").alias("hashes")), "jaccard-sets")
    comp = stored(components(links(sets, similarity)), "jaccard-roots")
    named = rows.select("doc_id", "row_key", "n", "node").join(comp, "node", "left").select(
        "doc_id", "row_key", "n", "node", F.coalesce("root", "node").alias("root"))
    # stored, so that the join back has an exchange on both sides, which Spark can split for a hot component
    least = stored(named.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("least"))
                   .withColumnRenamed("root", "r"), "jaccard-least")
    return (named.join(least, F.col("root") == F.col("r"), "left")
            .select("doc_id", "row_key", F.col("n").alias("n_shingles"), "node", "root",
                    F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id")))


def one_per_group(docs: DataFrame, width: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The documents (same columns), one of each component: the one with the smallest id, then text hash.

    Defined cases: documents without words all stay; rows that share id and text
    count as one, of which the one whose other columns are smallest (as JSON
    text) stays, however the rows are partitioned; a null id comes after every
    id; extra columns, whatever their names, are kept; an empty table gives no rows.
    """
    found = near_duplicates(docs, width, similarity)
    key = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(int(G.NO_ID)))
    first = (found.filter(F.col("root").isNotNull()).groupBy("root")
             .agg(F.min(F.struct(key("doc_id").alias("id"), "row_key")).alias("m")).select("m.id", "m.row_key"))
    blank = found.filter(F.col("root").isNull()).select(key("doc_id").alias("id"), "row_key").distinct()
    stay = first.union(blank).select(F.col("id").alias("s_id"), F.col("row_key").alias("s_key"))
    others = F.to_json(F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"]))
    rows = docs.select(F.struct("*").alias("row"), key("doc_id").alias("id"), F.xxhash64("text").alias("key"), others.alias("others"))
    kept = rows.join(stay, (F.col("id") == F.col("s_id")) & (F.col("key") == F.col("s_key")), "left_semi")
    kept = kept.groupBy("id", "key").agg(F.min_by("row", "others").alias("row"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 4], ' ')) AS h
  FROM d, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS s(i) WHERE len(w) > 0),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sh a JOIN sh b USING (h) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (
  SELECT u, v FROM pairs JOIN sz a ON a.doc_id = u JOIN sz b ON b.doc_id = v WHERE 100 * c >= 75 * (a.n + b.n - c)),
reach AS (
  SELECT doc_id AS u, doc_id AS v FROM d
  UNION
  SELECT reach.u, link.v FROM reach JOIN link ON reach.v = link.u)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM d LEFT JOIN sz USING (doc_id) JOIN (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u) USING (doc_id)
"""
