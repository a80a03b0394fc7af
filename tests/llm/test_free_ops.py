"""Small cases of the other operators, held against brute force."""

import collections
import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import grams, jaccard_join, license_scan, line_dedup, packing, substring_dedup, toxicity
from tessera.llm.components import components

DOCS = "doc_id long, text string, row_key long, doc long, `TEXT_` string, hi int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 5, 6, "x", 7) for i, t in rows], DOCS)


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def words(n, seed, vocabulary=50):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def space_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# ---- packed exchange -------------------------------------------------------------------------

def test_integer_packing_round_trips():
    for a in ([], [0], [1, 300, 70_000, 2**63, 2**64 - 1], list(range(1000))):
        a = np.array(a, dtype=np.uint64)
        assert (grams.unpack_ints(grams.pack_ints(a)) == a).all()
    for a in ([], [0], [-5, 7, -(2**63), 2**63 - 1, 0], list(range(1000, 0, -3))):
        a = np.array(a, dtype=np.int64)
        assert (grams.unpack_signed(grams.pack_signed(a)) == a).all()
    parts = [b"", b"abc", b"\0" * 9]
    assert grams.split_parts(grams.join_parts(parts)) == parts


def test_rolling_hash_equals_equal_windows():
    w = grams.WordHashes().of([x.encode() for x in words(3000, 1, 3)])
    h = grams.Rolling(7).hashes(w)
    seen = {}
    for i, x in enumerate(h):
        seen.setdefault(tuple(w[i:i + 7]), set()).add(int(x))
    assert all(len(x) == 1 for x in seen.values()) and len({x for s in seen.values() for x in s}) == len(seen)


# ---- substring dedup -------------------------------------------------------------------------

def plain_substring(rows, k):
    first = {}
    for i, t in rows:
        w = space_words(t)
        for a in range(len(w) - k + 1):
            key = tuple(w[a:a + k])
            rank = (i is None, i or 0)
            first[key] = min(first.get(key, rank), rank)
    out = []
    for i, t in rows:
        w, gone = space_words(t), set()
        for a in range(len(w) - k + 1):
            if first[tuple(w[a:a + k])] < (i is None, i or 0):
                gone |= set(range(a, a + k))
        out.append((i, len(w), len(gone), sha(" ".join(x for n, x in enumerate(w) if n not in gone))))
    return out


def substring_rows():
    passage, other = words(80, 3, 10_000), words(60, 4, 10_000)
    return [
        (5, " ".join(words(30, 5) + passage + words(20, 6))), (2, "\n".join(passage)), (9, " ".join(passage + other + passage)),
        (1, " ".join(other[:50])), (1, " ".join(other)), (7, None), (8, ""), (11, " ".join(words(49, 9, 10_000))),
        (12, "a " * 3000), (13, "a " * 120), (None, " ".join(passage)), (None, " ".join(passage)), (14, "\x1c ".join(passage)),
        (9, " ".join(passage + other + passage)), (15, "É b " * 60), (16, "É b " * 60),
    ]


@pytest.mark.parametrize("batch", [200, 500_000])
def test_substring_against_plain_python(spark, monkeypatch, batch):
    monkeypatch.setattr(grams, "BATCH_WINDOWS", batch)
    monkeypatch.setattr(grams, "BLOB_ENTRIES", 1)
    rows = substring_rows()
    got = [tuple(r) for r in substring_dedup.without_repeats(docs(spark, rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_substring(rows, 50)))


def test_substring_empty_and_text(spark):
    assert substring_dedup.without_repeats(docs(spark, [])).count() == 0
    out = substring_dedup.without_repeats(docs(spark, [(1, "a b c d"), (2, "x a b c y")]), window=3, with_text=True)
    assert {r.doc_id: r.kept_text for r in out.collect()} == {1: "a b c d", 2: "x y"}


@pytest.mark.parametrize("batch", [500_000, 300])
def test_equal_first_hashes_remove_nothing(spark, monkeypatch, batch):
    """Windows that share the first hash, in a batch and between batches, are told apart by the second."""
    monkeypatch.setattr(grams, "BATCH_WINDOWS", batch)
    monkeypatch.setattr(grams, "BLOB_ENTRIES", 1)
    real = grams.Rolling.hashes

    def crowded(self, w):
        h = real(self, w)
        return h % np.uint64(3) << np.uint64(20) if self.odd != grams.SECOND_ODD else h
    monkeypatch.setattr(grams.Rolling, "hashes", crowded)
    shared = " ".join(words(30, 99))
    rows = [(i, " ".join(words(90, i)) + " " + shared) for i in range(20)] + [(50, shared + " end"), (51, " ".join(words(60, 3)))]
    got = substring_dedup.without_repeats(docs(spark, rows), window=20)
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, plain_substring(rows, 20)))
    assert sum(r.n_removed > 0 for r in got.collect()) == 21


# ---- line dedup ------------------------------------------------------------------------------

def plain_lines(rows):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add((i is not None, i or 0))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 40 and len(holders[key(x)]) >= 5
                                         and (i is not None, i or 0) < max(holders[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def line_rows():
    common = "This Line Is Common Enough And Long Enough, 40+"
    hot = "é" * 40
    rows = [(i, f"own {i}\n  {common.upper() if i % 2 else common}\t\nshort\nshort") for i in range(6)]
    rows += [(i, f"{hot}\n{hot}\nrest {i}") for i in range(100, 180)]
    rows += [(300, None), (301, ""), (302, "\n\n"), (None, hot), (None, common), (170, "other text\n" + hot), (303, "é" * 39)]
    rows += [(400 + i, "four documents only hold this line, so it stays") for i in range(4)]
    rows += [(179, f"{hot}\n{hot}\nrest 179"), (500, "x" * 50_000 + "\n" + hot)]
    return rows


def test_lines_against_plain_python(spark):
    rows = line_rows()
    d = docs(spark, rows)
    got = [tuple(r) for r in line_dedup.apply_bitmaps(d, line_dedup.keep_bitmaps(d)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_lines(rows)))


def test_lines_of_one_partition_in_small_batches():
    """Groups that span batches, start and end a partition, reach the limit late or never: as in one batch."""
    import pyarrow as pa
    r = random.Random(6)
    for case in range(60):
        entries = sorted((r.randrange(3), r.randrange(2), r.randrange(12), r.randrange(2)) for _ in range(r.randrange(1, 60)))
        if case % 7 == 0:
            entries = [(0, 0, d, k) for _, _, d, k in entries]
        rows = pa.table({"hi": pa.array([e[0] for e in entries], pa.int64()), "lo": pa.array([e[1] for e in entries], pa.int64()),
                         "doc": pa.array([e[2] for e in entries], pa.int64()), "row_key": pa.array([e[3] for e in entries], pa.int64()),
                         "at": pa.array([[i] for i in range(len(entries))], pa.list_(pa.int32()))})
        rows = rows.sort_by([(c, "ascending") for c in ("hi", "lo", "doc", "row_key")])

        def decided(size):
            got = pa.Table.from_batches(line_dedup._stream(5)(iter(rows.to_batches(size)))).to_pylist()
            total = {}
            for g in got:
                if g["state"] == line_dedup._SUMMARY:
                    n, most = total.get((g["hi"], g["lo"]), (0, -1))
                    total[g["hi"], g["lo"]] = n + g["n"], max(most, g["doc"])
            gone = [g["at"][0] for g in got if g["state"] == line_dedup._DROP]
            for g in got:
                n, most = total.get((g["hi"], g["lo"]), (0, 0))
                if g["state"] == line_dedup._OPEN and n >= 5 and g["doc"] < most:
                    gone.append(g["at"][0])
            return sorted(gone)
        groups = {}
        for x in rows.to_pylist():
            groups.setdefault((x["hi"], x["lo"]), []).append((x["doc"], x["at"][0]))
        want = sorted(at for g in groups.values() if len({d for d, _ in g}) >= 5 for d, at in g if d < max(g)[0])
        assert decided(1) == decided(4) == decided(1000) == want


def test_lines_hot_key_over_many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = [(i, "this very common line is in every single document\nown " + str(i)) for i in range(800)]
        d = docs(spark, rows)
        got = [tuple(r) for r in line_dedup.apply_bitmaps(d, line_dedup.keep_bitmaps(d)).collect()]
        assert sorted(map(str, got)) == sorted(map(str, plain_lines(rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    empty = docs(spark, [])
    assert line_dedup.apply_bitmaps(empty, line_dedup.keep_bitmaps(empty)).count() == 0


# ---- Jaccard join ----------------------------------------------------------------------------

def plain_components(rows, links=False):
    sets = []
    for _, t in rows:
        w = space_words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[a:a + 5]) for a in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    out = []
    for a, (i, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if find(b) == find(a) and rows[b][0] is not None]
        out.append((i, len(sets[a]), min(ids) if ids else None))
    return out


def near_rows(seed=0):
    r = random.Random(seed)
    rows = []
    for g in range(12):  # groups of near copies with rising distance; chains link far ends
        base = words(r.randrange(40, 120), 100 + g, 10_000)
        for k in range(r.randrange(1, 14)):
            w = list(base)
            for _ in range(r.randrange(0, 5)):
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
            rows.append((len(rows) + 1, " ".join(w)))
            if r.random() < 0.4:
                base = w
    passage = words(60, 7, 10_000)
    rows += [(1000 + i, " ".join(passage + words(20 + i, 300 + i, 10_000))) for i in range(15)]
    rows += [(2000, None), (2001, " "), (2002, "a b"), (2003, "A\tb"), (2004, "b a"), (None, rows[0][1]), (None, "lonely words here"),
             (1, "same id but another text of more than five words"), (2, rows[1][1]), (2, rows[1][1]),
             (3000, " ".join(words(5000, 55, 100_000)))]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,batch,frequent", [(0, 500_000, 64), (1, 300, 4), (2, 300, 64)])
def test_components_of_near_copies(spark, monkeypatch, seed, batch, frequent):
    monkeypatch.setattr(grams, "BATCH_WINDOWS", batch)
    monkeypatch.setattr(grams, "BLOB_ENTRIES", 1)
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    rows = near_rows(seed)
    found = jaccard_join.near_duplicates(docs(spark, rows)).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, plain_components(rows)))


def test_one_per_group_and_empty(spark):
    rows = [(3, "one two three four five six"), (1, "one two three four five six"), (2, ""), (2, ""), (None, "x y")]
    d = docs(spark, rows)
    left = jaccard_join.one_per_group(d)
    assert left.columns == d.columns
    assert sorted(str((r.doc_id, r.text)) for r in left.collect()) == sorted(map(str, [
        (1, "one two three four five six"), (2, ""), (None, "x y")]))
    assert jaccard_join.one_per_group(docs(spark, [])).count() == 0


def test_one_per_group_does_not_depend_on_partitions(spark):
    text = "one two three four five six"
    d = spark.createDataFrame([(1, text, s, m) for s in ("q", "p", None) for m in ({"b": 1}, {"a": 2}, None)] + [(None, text, "z", None)] * 2
                              + [(None, None, "y", None), (None, None, "x", None), (2, text, "a", None)],
                              "doc_id long, text string, source string, others map<string,int>")
    seen = {str(sorted(map(str, jaccard_join.one_per_group(d.repartition(n, *c)).collect())))
            for n in (1, 3, 7) for c in ([], ["source"], ["doc_id"])}
    assert len(seen) == 1 and seen.pop().count("Row(") == 2


def test_components_of_links(spark):
    links = [(i, i + 1) for i in range(30)] + [(50, 51), (51, 52), (52, 50), (60, 60), (None, 1), (99, 0)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "u long, v long")).collect()))
    assert got == {**{i: 0 for i in range(31)}, 99: 0, 50: 50, 51: 50, 52: 50}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- licence scan ----------------------------------------------------------------------------

def test_automaton_matching_statistics():
    texts = [words(25, s, 6) for s in range(5)]
    a = license_scan.Automaton([[x.encode() for x in t] for t in texts], [])
    stream = words(400, 77, 7)
    _, matches = a.stream([x.encode() for x in stream], 2)

    def known(piece):
        return any(t[i:i + len(piece)] == piece for t in texts for i in range(len(t) - len(piece) + 1))
    longest = []
    for i in range(len(stream)):
        n = 0
        while n <= i and known(stream[i - n:i + 1]):
            n += 1
        longest.append(n)
    want = [(i, n) for i, n in enumerate(longest) if n >= 2 and (i + 1 == len(stream) or longest[i + 1] <= n)]
    assert [(e, n) for e, n, _ in matches] == want
    for end, n, state in matches:
        piece = stream[end - n + 1:end + 1]
        assert a.places[state] == {(t, i + n - 1) for t, x in enumerate(texts) for i in range(len(x) - n + 1) if x[i:i + n] == piece}


def license_rows():
    mit = license_scan.TEMPLATES[2][1]
    return [
        (1, "intro. Released under the MIT License."), (2, "CC BY and cc-by, CC  by"), (3, "All rights reserved. all RIGHTS reserved all"),
        (4, None), (5, ""), (6, "This work is licensed under the GNU General Public License, version 3."), (7, mit.upper()),
        (8, mit.replace("without restriction, including", "inserted words here") + " the end"), (9, "Licensed under CC BY-NC 4.0."),
        (9, "cc cc by by"), (None, "general public\nlicense"), (10, "mit license of the word " * 3000), (11, "École cc É by"),
        (12, "rights reserved all rights"),
    ]


def test_scan_against_plain_python(spark):
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)
           for r in license_scan.scan(docs(spark, license_rows())).collect()}
    want = set()
    for i, t in license_rows():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(a, label) for phrase, label in license_scan.BASE.items() for a in range(len(w))
              if w[a:a + len(phrase.split())] == phrase.split()]
        want.add((i, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))))
    assert got == want


def test_scan_labels_and_spans(spark):
    got = {r.doc_id: r for r in license_scan.scan(docs(spark, [x for x in license_rows() if x[0] not in (9, None)])).collect()}
    assert got[1].labels == "mit" and got[1].spans[0].asDict() == {"label": "mit", "start": 1, "end": 6, "coverage": 1.0}
    assert got[6].labels == "gpl,gpl-3.0" and got[7].labels == "mit" and got[8].labels == "mit"
    assert 0.8 < got[8].score < 1 and got[4].score == 0 and got[3].score == 1
    assert all(0 <= r.score <= 1 for r in got.values())
    assert license_scan.scan(docs(spark, [])).count() == 0


# ---- toxicity --------------------------------------------------------------------------------

def test_nearest_equals_exhaustive_search():
    r = np.random.default_rng(3)
    idf = r.uniform(1, 5, 40)
    examples = [(e, int(r.random() < 0.3), toxicity.unit({int(t): int(r.integers(1, 4)) for t in r.choice(40, r.integers(0, 6), False)}, idf))
                for e in range(3000)]
    index = toxicity.Index.build([b"w%d" % i for i in range(40)], idf, examples)
    for q in range(60):
        v = toxicity.unit({int(t): 1 for t in r.choice(40, 1 + q % 7, False)}, idf)
        cosines = [(-round(sum(w * v.get(t, 0) for t, w in x.items()), 9), e) for e, (_, _, x) in enumerate(examples)]
        want = [(e, -c) for c, e in sorted(x for x in cosines if x[0] < 0)[:25]]
        e, s = index.nearest(v, 25)
        assert e.tolist() == [x for x, _ in want] and np.allclose(s, [x for _, x in want], atol=1e-8)


def test_packed_term_counts_round_trip():
    for a in ([], [0], [0, 5, 70_000, 2**31], list(range(3000))):
        a = np.array(a, dtype=np.int64)
        assert (toxicity.unpack_rising(toxicity.pack_rising(a)) == a).all()
        n = (a + 1).astype(float)
        assert (toxicity.unpack_counts(toxicity.pack_counts(n)) == n).all()


def test_blocks_are_skipped_and_nothing_is_lost():
    """Terms of every kind: the search equals an exhaustive one and looks at a part of the examples."""
    r = np.random.default_rng(8)
    n, words = 2000, 3000
    share = np.minimum(0.4, 12.0 / (1 + np.arange(words)))
    idf = np.log(1 / share) + 1
    topic = r.integers(0, 8, n // 50)[np.arange(n) // 50]  # neighbours in id order are alike
    examples = []
    for e in range(n):
        has = np.flatnonzero(r.random(words) < share * (1 + 3 * (np.arange(words) % 8 == topic[e])))
        examples.append((e, 0, toxicity.unit({int(t): int(r.integers(1, 3)) for t in has}, idf)))
    index = toxicity.Index.build([b"w%d" % i for i in range(words)], idf, examples)
    assert len(index.often) > 20 and len(index.top) > 20 and len(index.example) > 1000
    for q in range(60):
        v = examples[q * 31][2] if q % 3 else toxicity.unit({int(t): 1 for t in r.choice(words, 40, False)}, idf)
        own = q * 31 if q % 3 == 1 else -1
        cosines = [(-round(sum(w * x.get(t, 0) for t, w in v.items()), 9), e) for e, (_, _, x) in enumerate(examples) if e != own]
        want = [(e, -c) for c, e in sorted(x for x in cosines if x[0] < 0)[:25]]
        e, s = index.nearest(v, 25, own)
        assert e.tolist() == [x for x, _ in want] and np.allclose(s, [x for _, x in want], atol=1e-8)
    assert index.asked == 60 and index.scored < 0.7 * 60 * n


def tox_tables(spark, n=600):
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        rows.append((i, " ".join(words(60, i, 1_000_000) + (["vile", "Nasty!"] if bad else []))))
        labels.append((i, int(bad), "x") if i % 7 else (i, None, "x"))
    rows += [(n, None), (n + 1, ""), (None, "vile nasty"), (n + 2, "w " * 30_000), (0, "vile nasty")]
    return docs(spark, rows), spark.createDataFrame([*labels, (3, 0, "x"), (None, 1, "x")], "doc_id long, toxic int, text string")


def test_scores_separate_and_ignore_ids(spark):
    d, labels = tox_tables(spark)
    index = toxicity.fit(d, labels)
    known = index.index()
    assert b"vile" in known.words and b"nasty" in known.words
    assert all(zlib.crc32(str(i).encode()) % 3 != 1 for i in known.ids)
    got = toxicity.scored(d, index).collect()
    assert len(got) == 605
    for r in got:
        toxic = r.doc_id is None or (r.doc_id < 600 and r.doc_id % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) == int(toxic)
    moved = toxicity.scored(d.withColumn("doc_id", F.lit(7).cast("long")), index).collect()
    assert sorted(r.score for r in moved) == sorted(r.score for r in got)
    kept = toxicity.fit(d, labels, keep_vectors=True)
    again = toxicity.scored_vectors(kept).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    left = toxicity.accepted(d, index)
    assert left.columns == d.columns and left.count() == sum(not r.predicted for r in got)


def test_toxicity_without_labels_or_rows(spark):
    d, labels = tox_tables(spark, 20)
    index = toxicity.fit(d, labels.limit(0))
    assert {r.score for r in toxicity.scored(d, index).collect()} == {0.5}
    empty = docs(spark, [])
    index = toxicity.fit(empty, labels)
    assert toxicity.scored(empty, index).count() == 0 and toxicity.accepted(empty, index).count() == 0


def test_bounds_by_block_hold_for_every_column():
    r = np.random.default_rng(11)
    idf = r.uniform(1, 3, 60)
    chance = np.concatenate([np.full(6, 0.4), np.full(14, 0.045), np.full(40, 0.01)])
    examples = [(e, 0, toxicity.unit({int(t): int(r.integers(1, 4)) for t in np.flatnonzero(r.random(60) < chance)}, idf)) for e in range(301)]
    index = toxicity.Index.build([b"w%d" % i for i in range(60)], idf, examples)
    assert len(index.often) and len(index.top) and len(index.example)
    assert sorted(index.example_of.tolist()) == list(range(301)) and (index.example_of[index.column_of] == np.arange(301)).all()
    blocks = index.top.shape[1]
    assert index.columns == blocks * toxicity.BLOCK >= 301 and index.columns % toxicity.GROUP == 0
    for e, _, v in examples:  # each weight of a term in between is within its block's greatest
        for t, w in v.items():
            if index.middle[t] >= 0:
                assert index.top[index.middle[t], index.column_of[e] % blocks] >= w


def test_index_is_built_in_little_memory(monkeypatch):
    """pipeline: the build took 64 bytes a term of an example beside the index, in each Python worker."""
    monkeypatch.setattr(toxicity, "ENTRIES", 1 << 14, raising=False)
    r = np.random.default_rng(12)
    n, known = 4000, 20_000
    terms = [np.unique((known * r.random(250) ** 3).astype(np.int32)) for _ in range(n)]
    entries = sum(map(len, terms))
    state = {"words": b"\n".join(b"w%d" % i for i in range(known)), "common": np.arange(100), "weights": r.uniform(1, 5, known),
             "ids": np.arange(n), "labels": np.arange(n) % 2, "sizes": np.array([len(t) for t in terms]),
             "terms": np.concatenate(terms), "counts": r.integers(1, 4, entries).astype(np.uint8)}
    tracemalloc.start()
    index = toxicity.Index.of_state(state)
    peak = tracemalloc.get_traced_memory()[1] - index.often.nbytes - index.top.nbytes
    tracemalloc.stop()
    assert len(index.often) and len(index.top) and len(index.example)
    assert peak < 30 * entries
    assert "names" not in vars(index)  # counted terms are searched without a table of words


def test_terms_counted_in_portions_are_those_of_each_text(monkeypatch):
    texts = [b"Run runs running, RUN", None, b"", b"unknown runnable", b"common common w " * 50, b"running", "\u00e9t\u00e9 w".encode()] * 20
    known = [b"common", b"commo*", b"run", b"runni*", b"running", b"runna*", b"w", "\u00e9t\u00e9".encode()]
    monkeypatch.setattr(toxicity, "PORTION", 300)
    names = toxicity.TermIds(b"\n".join(known), np.array([0, 6]))
    got = [dict(zip(t.tolist(), n.tolist())) for t, n in names.counted(texts)]
    want = []
    for text in texts:
        words = license_scan.words_of(text)
        has = collections.Counter([*words, *(w[:5] + b"*" for w in words if len(w) > 5)])
        want.append({known.index(w): n for w, n in has.items() if w in known})
    assert got == want and all(list(g) == sorted(g) for g in got)


def test_toxicity_keeps_every_term(spark):
    """Texts of terms that say nothing of the label have neighbours too, with cosines over all their terms."""
    rows = [(i, f"shared w{i} w{i + 1} {'vile' if i % 5 == 0 else 'kind'}") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    d = docs(spark, rows)
    index = toxicity.fit(d, labels).index()
    used = {i: t for i, t in rows if i in set(index.ids.tolist())}
    assert index.words.keys() == {w for t in used.values() for w in toxicity.terms_of(t.encode())} and (index.weights >= 1).all()
    e, s = index.nearest(index.vector(b"w7 w8"), 25)
    assert set(index.ids[e].tolist()) == {i for i, t in used.items() if {"w7", "w8"} & set(t.split())} and (s > 0).all()
    v = {i: index.vector(t.encode()) for i, t in used.items()}
    for n, i in enumerate(index.ids.tolist()[:20]):
        plain = [(-round(sum(w * x.get(t, 0) for t, w in v[i].items()), 9), m) for m, x in enumerate(v[j] for j in index.ids.tolist()) if m != n]
        e, s = index.nearest(v[i], 25, n)
        assert e.tolist() == [m for _, m in sorted(plain)[:25]]
        terms, weights = index.vectors([n])[0]
        assert dict(zip(terms.tolist(), weights.tolist())) == pytest.approx(v[i])


# ---- packing ---------------------------------------------------------------------------------

def test_best_fit_decreasing_against_plain_search():
    r = random.Random(5)
    for size in (1, 7, 64, 100):
        lengths = [r.randrange(1, size + 1) for _ in range(300)]
        rooms, want = [], []
        for i in sorted(range(300), key=lambda i: (-lengths[i], i)):
            fits = [x for x in rooms if x >= lengths[i]]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - lengths[i])
            else:
                rooms.append(size - lengths[i])
        got = packing.best_fit(lengths, size)
        assert sorted(i for s in got for i in s) == list(range(300))
        assert all(sum(lengths[i] for i in s) <= size for s in got)
        assert sorted(size - sum(lengths[i] for i in s) for s in got) == sorted(rooms)


@pytest.mark.parametrize("pool", [50, 4_000_000])
def test_packing_round_trip(spark, pool):
    rows = [(i, " ".join(words(i * 3 % 97, i))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "<|endoftext|> é\U0001f600\n\n  x"), (503, "long " * 30_000), (None, "no id"), (3, rows[3][1])]
    out = packing.packed(docs(spark, rows), seq_len=64, rows=8, pool_tokens=pool)
    enc = packing.encoding(packing.read_vocabulary())
    pieces, fill, room = {}, 0, 0
    for r in out.collect():
        assert r.n_rows <= 8 and len(r.ids) == r.n_rows * 64 * 2 and r.dtype == "<u2"
        room += r.n_rows * 64
        for cu, resets in zip(r.cu_seqlens, r.resets):
            assert cu[0] == 0 and cu == sorted(set(cu)) and cu[-1] <= 64
            p = packing.position_ids(cu, 64)
            assert [i for i in range(64) if p[i] == 0] == resets
            fill += cu[-1]
        for doc_id, offset, total, ids in packing.segments(r):
            pieces.setdefault(doc_id, []).append((offset, total, ids.tolist()))
    for doc_id, text in rows:
        own = sorted(pieces[doc_id], key=lambda x: x[0])
        if doc_id == 3:  # a repeated row is packed twice
            assert own[::2] == own[1::2]
            own = own[::2]
        ids = [x for _, _, piece in own for x in piece]
        assert len(ids) == own[0][1] and ids[-1] == packing.END_OF_TEXT
        assert enc.decode(ids[:-1]) == (text or "")
    assert sum(len(x) for x in pieces.values()) >= len(rows) and (pool < 64 or fill / room > 0.99)
    assert packing.packed(docs(spark, [])).count() == 0


def test_packing_ids_of_long_texts(spark):
    rows = [(0, "keitachlich " * 20_000), (1, "keit  achlich\n" * 9_000), (2, "ab" * 60_000), (3, "7 é's x² y_ 日本 語 " * 15_000)]
    enc, got = packing.encoding(packing.read_vocabulary()), {}
    for r in packing.packed(docs(spark, rows)).collect():
        for doc_id, offset, _, ids in packing.segments(r):
            got.setdefault(doc_id, {})[offset] = ids.tolist()
    for doc_id, text in rows:
        ids = [t for o in sorted(got[doc_id]) for t in got[doc_id][o]]
        assert len(text) > packing.CHUNK_CHARS and ids[:-1] == enc.encode(text, disallowed_special=())
    assert max(map(len, packing.chunks(rows[0][1]))) < packing.CHUNK_CHARS + 20
