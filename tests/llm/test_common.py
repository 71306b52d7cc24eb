"""Components, packing and the checked broadcast."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from docsearch.llm import blocks, common, quality
from pyspark.sql import functions as F


def test_components(spark):
    edges = [(k, k + 1) for k in range(100, 190)] + [(500, k) for k in range(501, 640)] + [(700, 701), (701, 700), (702, 702), (189, 300)]
    random.Random(0).shuffle(edges)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 100 for k in range(100, 191)} | {300: 100} | {k: 500 for k in range(500, 640)} | {700: 700, 701: 700}
    assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stars_take_no_step(spark, monkeypatch):
    tables, write = [], common.materialise
    monkeypatch.setattr(common, "materialise", lambda df, name: tables.append(name) or write(df, name))
    component = lambda edges: {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert component([(2, 1), (1, 3), (3, 1), (7, 8), (5, 5)]) == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    assert len(tables) == 1
    # a node with two edges, a triangle, a root that is a node itself
    assert component([(3, 1), (3, 2), (11, 12), (12, 13), (13, 11), (21, 20), (22, 21)]) == {1: 1, 2: 1, 3: 1, 11: 11, 12: 11, 13: 11, 20: 20, 21: 20, 22: 20}
    assert len(tables) > 2


def test_random_components(spark):
    rng = random.Random(1)
    for n in (6, 30, 60):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 2 + 2)]
        want = {x: x for e in edges if e[0] != e[1] for x in e}
        for _ in want:
            for a, b in edges:
                if a != b:
                    want[a] = want[b] = min(want[a], want[b])
        assert {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def test_the_driver_gives_memory_back(spark, monkeypatch):
    assert common.give_back_driver(spark)
    given, back = [], common.give_back_driver
    monkeypatch.setattr(common, "give_back_driver", lambda s: given.append("table") or back(s))
    common.materialise(spark.range(3), "three")
    monkeypatch.setattr(quality, "give_back", lambda: given.append("fit"))
    docs = spark.createDataFrame([(k, "a b c") for k in range(20)], "doc_id long, text string")
    quality.train(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality"))
    assert given == ["table", "fit"]


@given(st.lists(st.integers(0, 2**40), max_size=50))
def test_pack(xs):
    assert blocks.unpack(blocks.pack(np.array(xs, np.uint64), 8)).tolist() == xs


@given(st.lists(st.binary(max_size=20), max_size=30))
def test_pack_words(words):
    assert blocks.unpack_words(blocks.pack_words(words)) == words


def test_blocks_are_the_same_with_and_without_positions():
    texts = ["b a b", None, "", "a c " * 50, "d"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts)], ["id", "text"])
    split = lambda t: t.split()
    full, bare = (list(blocks.blocks(iter([batch]), split, positions=p, block_bytes=20)) for p in (True, False))
    assert [b.words for b in full] == [b.words for b in bare] and [b.ids for b in full] == [b.ids for b in bare]
    assert [w for b in full for w in (b.words[k] for k in b.ranks)] == [w for t in texts for w in (t or "").split()]


def test_small_is_counted(spark):
    long = spark.range(9).select(F.repeat(F.lit("x"), common.BROADCAST_BYTES // 9).alias("a"), F.array(F.lit("é")).alias("b"))
    assert "ResolvedHint" not in common.small(long)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in common.small(long.limit(3))._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in common.small(spark.range(5))._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in common.small(spark.range(common.BROADCAST_BYTES // 8 + 1))._jdf.queryExecution().analyzed().toString()
    assert spark.range(3).select(common.crc_mod(F.lit(None).cast("long"), 7)).first()[0] == 0
