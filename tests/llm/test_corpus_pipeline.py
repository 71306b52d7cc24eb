"""The corpus pipeline against plain versions of its stages."""

from __future__ import annotations

import hashlib

import tiktoken

import corpus_pipeline
from docsearch.llm.queries import tokenizer
from tests.llm.test_texts import classes, repetition

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    steps, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in now.collect()}
        now = stage(spark, now, SF)
        if name != "byte_level_bpe":
            assert now.columns == docs.columns
        now.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}")
        now = spark.read.parquet(path)
        steps[name] = (before, now)
    before, out = steps["quality_classifier"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in out.collect()}
    assert sum((i in kept) == bool(q) for i, q in labels.items()) >= 0.9 * len(labels)
    before, out = steps["quality_rules"]
    assert {r.doc_id for r in out.collect()} == {i for i, t in before.items() if not (x := repetition(t))[7] and x[5] <= 0.4 * x[0] and x[6] <= 100}
    before, out = steps["near_duplicates"]
    assert {r.doc_id for r in out.collect()} == {c for _, c in classes(list(before.items())).values()}
    before, out = steps["decontamination"]
    assert {r.doc_id for r in out.collect()} == {i for i, t in before.items() if not any(x in t for x in items)}
    before, out = steps["byte_level_bpe"]
    ranks, pattern = tokenizer()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = {i: hashlib.sha256(" ".join(map(str, library.encode_ordinary(t))).encode()).hexdigest() for i, t in before.items()}
    assert {r.doc_id: r.ids_sha256 for r in out.collect()} == want
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_odd_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (900, "", "en", "s", 0), (901, "x" * 100000, "en", "s", 1)], docs.schema)
    now = docs.limit(40).unionByName(odd)
    for _, stage in corpus_pipeline.STAGES:
        now.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/odd-{_}")
        now = stage(spark, spark.read.parquet(path), SF)
    assert now.count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0
