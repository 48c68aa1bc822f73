"""The pipeline stage by stage against plain Python."""

import math

import corpus_pipeline
from tidemark.llm import decontaminate, language, secrets

from .conftest import TEXTS

SF = "/root/testdata/sf0.001"


def test_stages_keep_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stage = dict(corpus_pipeline.STAGES)
    one = stage["language ID"](spark, docs, SF).cache()
    assert one.columns == docs.columns and one.count() == docs.count()
    two = stage["SimHash near-dedup"](spark, one, SF).cache()
    assert two.columns == docs.columns and 0 < two.count() < one.count()
    texts = {r.doc_id: r.text for r in two.collect()}
    three = stage["benchmark decontamination"](spark, two, SF).cache()
    found = decontaminate.brute_force(texts.items(), items)
    assert {r.doc_id for r in three.collect()} == {
        i for i, (n, hit, *_) in found.items() if not (hit and 20 * hit >= n)}
    four = stage["secret scans"](spark, three, SF).cache()
    assert four.columns == docs.columns and four.count() == three.count()
    for r in four.collect():
        assert not secrets.base_spans(r.text) and (
            r.text == texts[r.doc_id] or "[SECRET]" in r.text)
    five = stage["packing"](spark, four, SF)
    assert {r.doc_id for r in five.collect()} == {r.doc_id for r in four.collect()}


def test_stages_on_odd_rows(spark, docs, empty):
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        last = out
        out = stage(spark, out, SF).cache()
        if name != "packing":
            assert out.columns == docs.columns
        if name == "language ID":
            kept = sorted(str(r.doc_id) for r in out.select("doc_id").collect())
            assert kept == sorted(str(i) for i, t in TEXTS if t and any(c.isalpha() for c in t))
        if name == "SimHash near-dedup":
            ids = [r.doc_id for r in out.select("doc_id").collect()]
            assert len(ids) == len(set(ids)) and 0 in ids and 3 not in ids
    assert last.count() and out.count()
    out = empty
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF).cache()
    assert out.count() == 0


def test_language_stage_rejects_what_fits_no_language(spark):
    """Scripts that no training text has go; the texts of the table and short ones stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(10**6, "\u16a0\u16a2\u16a6\u16a8 " * 40), (10**6 + 1, "\u4dc0\U00010400\U00010401 " * 30),
           (10**6 + 2, "the"), (10**6 + 3, "12 34"), (10**6 + 4, None)]
    more = spark.createDataFrame([(i, t, None, "s", 1) for i, t in odd], docs.schema)
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["language ID"](
        spark, docs.unionByName(more), SF).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()} | {10**6 + 2}


def test_floor_counts_every_labelled_text(spark):
    """One badly fitting text in a thousand moves the floor, whatever its id."""
    rows = [(i, "x", -2.0) for i in range(1000)]
    for odd in (3, 500, 999):
        fits = spark.createDataFrame([(i, lang, -9.0 if i == odd else fit) for i, lang, fit in rows]
                                     + [(2000, None, -50.0), (2001, "x", -math.inf)],
                                     "doc_id bigint, lang string, fit double")
        assert language.floor(fits) == -16.0
    assert language.floor(fits.limit(0)) == -math.inf


def test_contamination_needs_one_python_worker_a_task(spark):
    """Items twice, document rows and merged hits; grams are extended without a Python step."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    found = decontaminate.contamination(docs, items)
    text = found._jdf.queryExecution().sparkPlan().toString()
    assert text.count("MapInArrow") == 3 and "_extend" not in text
