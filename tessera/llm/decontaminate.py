"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

An item is cut into windows of ``window`` consecutive words (a shorter item is
one window).  A window's set is its 3-word shingles (fewer words: the whole
window).  Exact containment needs every shingle, so one necessary shingle, the
rarest, is a complete prefix:

1. count the items' shingles over all documents (partial counts per task);
2. order each window's shingles by that count and keep the rarest as prefix;
   windows with a shingle that no document has cannot occur and are dropped;
3. join the prefixes with the documents' shingles, apply the length and
   positional bounds (the window has to fit around the shingle), and compare the
   window's words with the document's words at that place.

The document side is scanned, exploded and probed in one stage without a
shuffle; only verified hits are shuffled.  The item side is broadcast in blocks
of at most ``block_rows`` rows of one window each, so its memory is bounded however
large the benchmark is and however many items share a window: which items hold
it is joined to the verified hits, by the window's number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, stored

WINDOW = 10
SHINGLE = 3
BLOCK_ROWS = 200_000


NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NO_WORD_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same before A-Z are lower-cased


def pieces(text: Column) -> Column:
    """The words of a text; an empty piece stands before a leading and after a trailing separator."""
    return F.split(ascii_lower(F.coalesce(text, F.lit(""))), NO_WORD, -1)


def _leading(words: str) -> Column:
    return (F.get(words, F.lit(0)) == "").cast("int")


def item_windows(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (win_id, win, len), and which items (ids as text) hold them (win_id, item)."""
    w = (items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                      F.filter(pieces(F.col("text")), lambda w: w != "").alias("words"))
         .filter(F.size("words") > 0)
         .withColumn("len", F.least(F.size("words"), F.lit(window)))
         .withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1)))
         .select("item", "len", F.slice("words", F.col("at"), F.col("len")).alias("win")))
    # words hold no blank, so the joined window is the window
    w = stored(w.select(F.md5(F.array_join("win", " ")).alias("win_id"), "win", "len", "item").distinct(), "decon-windows")
    return w.select("win_id", "win", "len").distinct(), w.select("win_id", "item")


def _key(hashes: list[Column]) -> Column:
    return F.xxhash64(F.lit(len(hashes)), *hashes)


def _window_shingles(windows: DataFrame) -> DataFrame:
    """(win_id, win, len, off, key, size): every shingle of every window."""
    size = F.least(F.col("len"), F.lit(SHINGLE))
    at = windows.select("win_id", "win", "len", size.alias("size"),
                        F.explode(F.sequence(F.lit(0), F.col("len") - size)).alias("off"))
    key = None
    for k in range(1, SHINGLE + 1):
        own = _key([F.xxhash64(F.get("win", F.col("off") + j)) for j in range(k)])
        key = F.when(F.col("size") == k, own) if key is None else key.when(F.col("size") == k, own)
    return at.withColumn("key", key)


def _doc_shingles(docs: DataFrame, size: int, keep: list[str]) -> DataFrame:
    """(keep..., words, pos, key): every shingle of ``size`` words of every document.

    The outer explode keeps the optimizer from adding a filter on the split
    text, which would split it again.
    """
    at = (docs.select(*keep, pieces(F.col("text")).alias("words"))
          .select(*keep, "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hs"))
          .select(*keep, "words", "hs", F.posexplode_outer("hs").alias("pos", "h0")))
    if size > 1:
        at = at.filter(F.col("pos") + (size - 1) < F.size("hs"))
    rest = [F.get("hs", F.col("pos") + j) for j in range(1, size)]
    return at.select(*keep, "words", "pos", _key([F.col("h0"), *rest]).alias("key"))


def _blocks(df: DataFrame, by: str, rows: int, limit: int) -> list[DataFrame]:
    n = max(1, -(-rows // limit))
    if n == 1:
        return [df]
    return [df.filter(F.pmod(F.xxhash64(by), F.lit(n)) == b) for b in range(n)]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row_key, start, len, win_id): every occurrence of an item window in a document; and (win_id, item)."""
    base = docs.select(F.col("doc_id"), F.xxhash64(F.col("text")).alias("row_key"), F.col("text"))
    windows, held_by = item_windows(items, window)
    shingles = stored(_window_shingles(windows), "decon-shingles")
    sizes = [(r["size"], r["n"]) for r in shingles.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()]
    if not sizes:
        return _no_hits(base), held_by
    counts = []
    for size, n in sizes:  # at most SHINGLE sizes
        keys = shingles.filter(F.col("size") == size).select("key").distinct()
        for block in _blocks(keys, "key", n, block_rows):
            counts.append(_doc_shingles(base, size, []).join(F.broadcast(block), "key")
                          .groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    counted = shingles.join(_union(counts), "key", "left")
    prefix = (counted.groupBy("win_id", "win", "len")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "off", "size")).alias("p"))
              .filter(F.col("p.n") > 0)
              .select("win_id", "win", "len", "p.key", "p.off", "p.size"))
    prefix = stored(prefix, "decon-prefix")
    found = []
    for size, n in ((r["size"], r["n"]) for r in prefix.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()):
        for block in _blocks(prefix.filter(F.col("size") == size).drop("size"), "key", n, block_rows):
            cand = _doc_shingles(base, size, ["doc_id", "row_key"]).join(F.broadcast(block), "key")
            start = F.col("pos") - F.col("off")
            found.append(cand.filter((start >= 0) & (start + F.col("len") <= F.size("words")))
                         .filter(F.slice("words", start + 1, F.col("len")) == F.col("win"))
                         .select("doc_id", "row_key", (start - _leading("words")).alias("start"), "len", "win_id"))
    return (_union(found) if found else _no_hits(base)), held_by


def _no_hits(base: DataFrame) -> DataFrame:
    return (base.filter(F.lit(False))
            .select("doc_id", "row_key", F.lit(0).alias("start"), F.lit(0).alias("len"), F.lit("").alias("win_id")))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, row_key, n_words, n_hit, n_items, items_sha256, contaminated, spans, items.

    ``spans`` lists the hit windows (start, len) in words.

    Defined cases: null text has no words; an item without words has no window;
    a null item id counts as the empty string; rows that share id and text share
    one result, rows that share an id only are told apart by ``row_key``; a null
    doc_id is a row like any other; empty tables give no hits or no rows.
    """
    found, held_by = hits(docs, items, window)
    found = stored(found, "decon-hits")
    spans = found.groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_set(F.struct("start", "len"))).alias("spans"))
    held = (found.select("doc_id", "row_key", "win_id").distinct().join(held_by, "win_id").groupBy("doc_id", "row_key")
            .agg(F.array_sort(F.collect_set("item")).alias("items")).select(F.col("doc_id").alias("i_id"), F.col("row_key").alias("i_key"), "items"))
    per_doc = spans.join(held, F.col("doc_id").eqNullSafe(F.col("i_id")) & (F.col("row_key") == F.col("i_key"))).drop("i_id", "i_key")
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(s["start"], acc["end"]))).alias("n"),
            F.greatest(acc["end"], s["start"] + s["len"]).alias("end")), lambda acc: acc["n"])
    per_doc = per_doc.select(F.col("doc_id").alias("h_id"), F.col("row_key").alias("h_key"),
                             covered.alias("hit"), "spans", "items")
    trailing = ((F.size("words") > 1) & (F.get("words", F.size("words") - 1) == "")).cast("int")
    base = (docs.select("doc_id", F.xxhash64("text").alias("row_key"),
                        F.split(F.coalesce("text", F.lit("")), NO_WORD_ANY_CASE, -1).alias("words"))
            .select("doc_id", "row_key",
                    (F.size("words") - _leading("words") - trailing).cast("bigint").alias("n_words")))
    out = base.join(per_doc, base.doc_id.eqNullSafe(F.col("h_id")) & (base.row_key == F.col("h_key")), "left")
    ids = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return out.select("doc_id", "row_key", "n_words", F.coalesce("hit", F.lit(0)).cast("bigint").alias("n_hit"),
                      F.size(ids).cast("bigint").alias("n_items"),
                      F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
                      (F.coalesce("hit", F.lit(0)) > 0).alias("contaminated"), "spans", ids.alias("items"))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents (same columns) that hold no item window.

    Defined cases: as ``contamination``; a row stays or goes by its own id and text, so
    repeated rows share their fate; extra columns, whatever their names, are kept; without items all rows stay.
    """
    bad = (hits(docs, items, window)[0].select(F.col("doc_id").alias("h_id"), F.col("row_key").alias("h_key")).distinct())
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"))
    left = rows.join(bad, F.col("id").eqNullSafe(F.col("h_id")) & (F.col("key") == F.col("h_key")), "left_anti")
    return left.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM b, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM win),
occ AS (
  SELECT doc_id, i, ks.k, array_to_string(w[i : i + ks.k - 1], ' ') AS win
  FROM d, ks, unnest(generate_series(1, greatest(len(w) - ks.k + 1, 0))) AS s(i)),
hit AS (SELECT o.doc_id, o.i, o.k, win.item_id FROM occ o JOIN win ON o.k = win.k AND o.win = win.win),
pos AS (SELECT DISTINCT doc_id, p FROM hit, unnest(generate_series(i, i + k - 1)) AS s(p)),
per AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN its USING (doc_id)
"""
