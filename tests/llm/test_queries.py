"""The registered queries and the pipeline over the smallest driver tables."""

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import chat_format, decontaminate, mixing, packing, queries, toxicity
from tessera.llm.common import stored, table
from tests.conftest import SF

CONTRACT = {
    "op1": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op2": "doc_id held_out score predicted",
    "op3": "doc_id size source_size target taken",
    "op5": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op6": "doc_id n_lines n_dropped kept_sha256",
    "op7": "doc_id n_shingles component_id",
    "op8": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op9": "doc_id n_words n_removed kept_sha256",
    "op10": "doc_id keep_id group_size kept text_sha256",
    "op11": "page_id host path rule verdict",
    "op12": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "op13": "vec_id component n deviation whitened explained identity_error",
}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(queries.SQL[name]).fetchall()
    at = [[d[0] for d in con.description].index(c) for c in cols]
    assert sorted(str(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(str(tuple(r[i] for i in at)) for r in want)


def test_contract_columns(spark):
    for name, fn in queries.QUERIES.items():
        want = CONTRACT.get(name.split("_")[0])
        if want:
            assert set(want.split()) <= set(fn(spark, SF).columns), name


def test_stages_follow_each_other(spark):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near duplicates", "decontamination", "mixing", "packing"]
    seen = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        kept = stored(stage(spark, docs, SF), "test-stage")
        if name != "packing":
            assert kept.columns == docs.columns
        seen[name], docs = kept, kept
    ids = {k: {r.doc_id for r in v.select("doc_id").collect()} for k, v in seen.items() if k != "packing"}
    # toxicity: exactly the documents that the fitted index accepts
    index = toxicity.fit(seen["documents"], table(spark, SF, "labels"))
    good = {r.doc_id for r in toxicity.scored(seen["documents"], index).collect() if not r.predicted}
    assert ids["toxicity"] == good
    # near duplicates: the smallest id of each component of what toxicity kept
    from tests.llm.test_free_ops import plain_components
    rows = [(r.doc_id, r.text) for r in seen["toxicity"].collect()]
    assert ids["near duplicates"] == {c for i, n, c in plain_components(rows) if n} | {i for i, n, _ in plain_components(rows) if not n}
    # decontamination: no item window is left, and clean documents stay
    from tests.llm.test_native_ops import plain_hits
    rows = [(r.doc_id, r.text) for r in seen["near duplicates"].collect()]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    assert ids["decontamination"] == {r[0] for r in plain_hits(rows, items) if not r[5]}
    # mixing: as many copies as the mix takes
    took = {r.doc_id: r.taken // r["size"] if r["size"] else None for r in mixing.taken(seen["decontamination"]).collect()}
    copies = {}
    for r in seen["mixing"].select("doc_id").collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert all(n is None or copies.get(i, 0) == n for i, n in took.items())
    # packing: every copy is packed whole
    enc, text = packing.encoding(packing.read_vocabulary()), {r.doc_id: r.text for r in seen["mixing"].collect()}
    packed = {}
    for row in seen["packing"].collect():
        for doc_id, offset, total, piece in packing.segments(row):
            packed.setdefault(doc_id, {}).setdefault(offset, []).append(piece)
    assert {i: len(p[0]) for i, p in packed.items()} == copies
    assert all(enc.decode(np.concatenate([p[o][0] for o in sorted(p)])[:-1].tolist()) == (text[i] or "") for i, p in packed.items())


def test_pipeline_run_returns_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns == [c.split()[0] for c in packing.SCHEMA.split(", ")]


def test_native_operators_use_no_python(spark):
    docs, turns = table(spark, SF, "documents"), table(spark, SF, "conversations")
    for df in (mixing.taken(docs), mixing.emit(docs), decontaminate.clean(docs, table(spark, SF, "benchmark")),
               queries.op10_exact_dedup(spark, SF), chat_format.digest(chat_format.prefix_examples(turns))):
        plan = df._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "InArrow", "CartesianProduct", "BroadcastNestedLoop"))


def test_toxicity_of_held_out_documents(spark):
    got = queries.op2_toxicity(spark, "/root/testdata/sf0.01")
    truth = table(spark, "/root/testdata/sf0.01", "labels").select("doc_id", "toxic")
    rows = got.filter("held_out").join(truth, "doc_id").collect()
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    false_alarms = sum(r.predicted for r in rows if not r.toxic) / sum(not r.toxic for r in rows)
    caught = sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows)
    assert right > 0.93 and false_alarms < 0.03 and caught > 0.7
    best = sorted(rows, key=lambda r: -r.score)
    assert all(r.toxic for r in best[:10])


DIRTY = ("doc_id long, text string, lang string, source string, n_chars long, row string, key int, id int, size int, copies string, "
         "rank int, `Others` int, score double, label int, win_id string, item string, u int, h_id int")


def dirty_docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, "r", 2, 3, 4, "c", 5, 6, 7.0, 8, "w", "i", 9, 10) for i, t, s in rows], DIRTY)


def test_stages_on_dirty_documents(spark):
    """Null ids, texts and sources, empty and long texts, repeated rows, clashing column names: nothing clean is lost."""
    plain = [r.text for r in table(spark, SF, "documents").orderBy("doc_id").limit(30).collect()]
    rows = [(i, t, "a" if i % 2 else None) for i, t in enumerate(plain)]
    rows += [(None, plain[0] + " tail of its own", "b"), (None, None, None), (100, None, "a"), (101, "", "b"), (102, " \n ", "b"),
             (103, "word " * 30_000, "a"), (5, plain[5], "a"), (104, plain[7], "z"), (104, plain[7], "y")]
    docs = dirty_docs(spark, rows)
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stored(stage(spark, docs, SF), "test-dirty")
        assert kept.columns == docs.columns, name
        texts = [r.text for r in kept.collect()]
        assert set(texts) <= {t for _, t, _ in rows}, name
        if name == "near duplicates":
            assert texts.count(plain[7]) == 1 and texts.count(plain[5]) == 1
            assert sum(t is None for t in texts) == 2 and "" in texts and " \n " in texts
        if name == "decontamination":
            assert {r.lang for r in kept.collect()} == {"en"} and len(texts) >= len(rows) - sum(any(w in (t or "") for w in items) for _, t, _ in rows) - 30
            assert texts.count(None) == 2
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.count() > 0 and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
