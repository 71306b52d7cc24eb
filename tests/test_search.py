"""Query sets of any size."""

from __future__ import annotations

from docsearch.operators import search
from docsearch.plans import search_queries


def test_large_query_sets_go_in_blocks(spark, monkeypatch):
    vectors = search_queries.vectors(spark, "/root/testdata/sf0.001")
    queries = vectors.where("child_id < 40").selectExpr("child_id as query_id", "vector")
    whole = sorted(map(tuple, search.dense(queries, vectors, 3).collect()))
    monkeypatch.setattr(search, "MOST_QUERIES", 20)
    assert sorted(map(tuple, search.dense(queries, vectors, 3).collect())) == whole and len(whole) == 120


def test_large_term_sets_are_shuffled(spark, monkeypatch):
    docs = search_queries.children(spark, "/root/testdata/sf0.001")
    post = search.postings(docs)
    stats = search.totals(post, docs)
    terms = search.term_weights(search.frequencies(post), stats)
    queries = docs.where("child_id < 5").selectExpr("child_id as query_id", "left(text, 200) as text")
    whole = sorted(map(tuple, search.sparse(queries, post, terms, stats, 4).collect()))
    monkeypatch.setattr(search, "MOST_TERMS", 0)
    assert sorted(map(tuple, search.sparse(queries, post, terms, stats, 4).collect())) == whole and whole
