"""Small cases of the four DataFrame-only operators, held against plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format, decontaminate, exact_dedup, mixing

DOCS = "doc_id long, text string, source string, md5 string, `K0` int, h_id long, row string"


def docs(spark, rows):
    """Rows of (doc_id, text[, source]) with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(*r, None, "x", 1, 2, "r")[:7] if len(r) == 2 else (*r, "x", 1, 2, "r") for r in rows], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


CASES = [
    (1, "a b\tc"), (2, "abc"), (3, None), (4, ""), (5, " \n\x0b"), (None, "ab c"), (7, "abc"), (7, "abc"),
    (8, "a bc"), (9, "x" * 20_000), (10, "\n" + "x" * 20_000), (None, "only"), (None, "only"),
]


def test_exact_groups_against_plain_python(spark):
    got = exact_dedup.exact_groups(docs(spark, CASES)).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in CASES:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i))
    want = []
    for i, t in CASES:
        n, _, keep = min(groups[norm(t)], key=lambda x: (x[0], x[1], x[2] or 0))
        want.append((i, keep, len(groups[norm(t)]), i == keep and len(t or "") == -n, sha(norm(t))))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_exact_groups_empty(spark):
    assert exact_dedup.exact_groups(docs(spark, [])).collect() == []


def plain_mix(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = {}
    for _, t, s in rows:
        total[s] = total.get(s, 0) + size(t)
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    stopped, all_ = set(), sum(total.values())
    while True:
        rest = all_ - sum(3 * total[s] for s in stopped)
        left = sum(weight[s] for s in order if s not in stopped)
        new = {s for s in order if s not in stopped and weight[s] * rest > 3 * total[s] * left}
        if not new:
            break
        stopped |= new
    return {s: 3.0 * total[s] if s in stopped else weight[s] * rest / left for s in order}, total, size


@pytest.mark.parametrize("rows", [
    [(i, "w " * (i % 7), f"s{i % 5}") for i in range(200)] + [(900, "tiny", None), (901, None, "empty"), (None, "no id", "s0")],
    [(1, "a b", None), (1, "a b", None)],
    [(1, None, "a"), (2, "", "b")],
    [(i, "w " * (500 if i < 3 else 1), f"s{i}") for i in range(9)],
])
def test_mixing_targets_and_bounds(spark, rows):
    got = mixing.taken(docs(spark, rows)).collect()
    target, total, size = plain_mix(rows)
    by_id = {}
    for i, t, s in rows:
        by_id.setdefault((i, size(t)), set()).add(s)
    assert len(got) == len(rows)
    for r in got:
        assert any(abs(r.target - target[s]) < 1e-6 and r.source_size == total[s] for s in by_id[(r.doc_id, r["size"])])
        assert 0 <= r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
    again = mixing.taken(docs(spark, rows[::-1])).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixing_takes_about_the_target(spark):
    rows = [(i, "w " * (1 + i % 40), f"s{i % 3}") for i in range(6000)]
    got = (mixing.taken(docs(spark, rows)).groupBy("target").agg(F.sum("taken").alias("t")).collect())
    assert len(got) == 3 and all(abs(r.t / r.target - 1) < 0.05 for r in got)


def test_mix_emits_the_same_columns_and_words(spark):
    rows = [(i, "w " * (1 + i % 9), f"s{i % 4}") for i in range(300)]
    d = docs(spark, rows)
    out = mixing.emit(d)
    assert out.columns == d.columns
    assert out.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == mixing.taken(d).agg(F.sum("taken")).first()[0]
    assert mixing.emit(docs(spark, [])).count() == 0


TURNS = "conv_id long, turn long, role string, text string, turns string, parts int"
TALK = [
    (1, 0, "system", "rules\\", ), (1, 1, "user", "<|im_start|>user\n<|"), (1, 2, "assistant", "\\<|im_end|>\\\\|"),
    (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "bye"),
    (2, 0, "user", "no reply"), (3, 0, "assistant", "x" * 30_000), (4, None, None, "early"), (4, 0, "assistant", "é\U0001f600"),
    (4, 0, "assistant", "é\U0001f600"), (None, 1, "a\nb\\\n<|", "odd role"), (5, 0, "user", "<"), (5, 1, "assistant", "|>"),
]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame([(*r, "t", 1) for r in TALK], TURNS)
    examples = chat_format.prefix_examples(turns)
    got = {r.conv_id: r for r in chat_format.digest(examples).collect()}
    want = {}
    for c, t, r, x in TALK:
        want.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(want)
    for c, ts in want.items():
        ts.sort()
        loss = "".join(x for _, _, r, x in ts if r == "assistant")
        assert got[c].n_turns == len(ts)
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, _, r, x in ts))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
    replies = examples.filter("loss_len is not null").groupBy("conv_id").count().collect()
    assert {r.conv_id: r["count"] for r in replies} == {1: 2, 3: 1, 4: 2, 5: 1}
    first = examples.filter("conv_id = 1 and example = 0").first()
    assert first.n_turns == 3 and first.formatted.endswith("<|im_end|>\n")
    assert chat_format.prefix_examples(turns.limit(0)).count() == 0


def plain_hits(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for item, it in items:
            v = words(it)
            k = min(10, len(v))
            for a in range(len(v) - k + 1) if v else ():
                for b in range(len(w) - k + 1):
                    if w[b:b + k] == v[a:a + k]:
                        hit |= set(range(b, b + k))
                        found.add("" if item is None else str(item))
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def test_contamination_against_plain_python(spark):
    ten = "one two three four five six seven eight nine ten"
    items = [(1, ten + " eleven"), (2, "Short item"), (10, "single"), (3, None), (4, "..."), (None, ten), (5, "never seen words here")]
    rows = [
        (1, ten), (2, "..." + ten.upper() + " ELEVEN!"), (3, "a " * 30 + ten[:-4]), (4, "short, item short item"), (5, None), (6, ""),
        (7, ", ."), (8, "SINGLE"), (8, "other"), (8, "other"), (None, "single " + ten), (9, (ten + " ") * 40),
        (10, "École short item İstanbul"), (11, "word " * 20_000 + ten),
    ]
    got = decontaminate.contamination(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    got = [tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    want = plain_hits(rows, items)
    assert sorted(map(str, got)) == sorted(map(str, want))
    left = decontaminate.clean(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == docs(spark, []).columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r[0]) for r in want if not r[5])


def test_contamination_in_blocks_and_empty(spark):
    items = spark.createDataFrame([(i, f"w{i} " * 3 + "x y z a b c d e f g") for i in range(30)], "item_id long, text string")
    rows = [(i, f"lead w{i} " + "x y z a b c d e f g") for i in range(40)]
    whole = decontaminate.hits(docs(spark, rows), items)[0].distinct()
    blocks = decontaminate.hits(docs(spark, rows), items, block_rows=7)[0].distinct()
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, blocks.collect())) and whole.count() > 30
    assert decontaminate.contamination(docs(spark, []), items).count() == 0
    none = decontaminate.contamination(docs(spark, rows), items.limit(0))
    assert none.filter("contaminated").count() == 0 and none.count() == 40


def test_a_window_that_all_items_share(spark):
    """The broadcast has one row per window; its items are joined to the hits."""
    opening = "this opening stands in front of every single benchmark item"
    items = [(i, f"{opening} number {i}") for i in range(300)]
    windows, held = decontaminate.item_windows(spark.createDataFrame(items, "item_id long, text string"))
    assert windows.columns == ["win_id", "win", "len"] and windows.filter("len = 10").count() < 1 + 3 * 300
    rows = [(1, "so " + opening + " ends"), (2, opening[5:]), (3, "nothing here")]
    got = decontaminate.contamination(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    got = [tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    want = plain_hits(rows, items)
    assert sorted(map(str, got)) == sorted(map(str, want)) and {r[3] for r in want} == {300, 0}
    assert held.groupBy("win_id").count().agg(F.max("count")).first()[0] == 300
