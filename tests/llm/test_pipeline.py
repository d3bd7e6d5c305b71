"""Each stage against a plain version on the sample documents."""

import pytest

import corpus_pipeline
from conftest import SF
from estatelens.llm import minhash, mixing, packing, repetition, templates
from estatelens.scratch import materialize
from llm_fixtures import duck_docs  # noqa: F401
from test_models_and_files import check_packing


@pytest.fixture(scope="module")
def stages(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(materialize(stage(spark, docs[-1], SF)))
    return docs


def sql_on(duck_docs, docs, sql):
    names, rows = duck_docs([(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()], sql)
    return [dict(zip(names, r, strict=True)) for r in rows]


def test_columns_stay(stages):
    assert [s.columns for s in stages[:5]] == [stages[0].columns] * 5
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5


def test_quality(stages, duck_docs):
    want = {r["doc_id"] for r in sql_on(duck_docs, stages[0], repetition.SQL) if r["kept"]}
    assert {r.doc_id for r in stages[1].collect()} == want


def test_line_dedup(stages, duck_docs):
    want = {r["doc_id"]: r["text"] for r in sql_on(duck_docs, stages[1], templates.SQL) if not r["n_dropped"] or r["text"].split()}
    got = stages[2].collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_near_dedup(stages, duck_docs):
    want = {r["doc_id"] for r in sql_on(duck_docs, stages[2], minhash.SQL) if r["kept"]}
    assert {r.doc_id for r in stages[3].collect()} == want


def test_mixing(stages, duck_docs):
    want = sorted(r["doc_id"] for r in sql_on(duck_docs, stages[3], mixing.SQL))
    assert sorted(r.doc_id for r in stages[4].collect()) == want and set(want) == {r.doc_id for r in stages[3].collect()}


def test_packing(stages):
    times = {}
    for r in stages[4].collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    once = stages[4].dropDuplicates(["doc_id"])
    rows = [(r.doc_id, r.text) for r in once.collect()]
    used, least = check_packing(rows, packing.pack(once).collect())
    assert used <= least * 1.02 + 2
    placed = {}
    for r in stages[5].filter("piece = 0").collect():
        placed[r.doc_id] = placed.get(r.doc_id, 0) + 1
    assert placed == times


def test_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).selectExpr(
        "*", "1 as slot", "2 as epoch", "3 as kept", "4 as lost", "5 as node", "6 as rank", "7 as key")
    want = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF))
        assert docs.columns == want
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).columns[-1] == "offset"


def test_near_dedup_of_odd_rows(spark):
    text, solo, lost = ("%s one two three four five six seven eight nine" % w for w in ("copied", "only", "nameless"))
    rows = [(None, text), (7, text), (7, text), (None, text), (9, text), (9, solo), (None, lost), (None, lost), (None, None), (None, ""), (8, "")]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(7, text), (9, solo), (None, lost), (None, None), (None, ""), (8, "")], key=repr)


def test_mixing_writes_in_slot_order(spark):
    docs = spark.createDataFrame([(k, "t", f"s{k % 3}") for k in range(3000)], "doc_id long, text string, source string")
    slot = {r.doc_id: r.slot for r in mixing.mix(docs).filter("epoch = 0").collect()}
    got = [slot[r.doc_id] for r in corpus_pipeline.mixing_sources(spark, docs, SF).collect()]
    assert len(got) == 3000 and got == sorted(got)
