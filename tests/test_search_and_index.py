"""Ties, cuts, zero scores and unknown terms of the two kinds of search."""

from math import isclose, sqrt

import pytest

from lumenary.operators import index, search


def vectors(spark, rows):
    return spark.createDataFrame(rows, "key long, vector array<double>")


def test_knn_tie_goes_to_the_lower_key(spark):
    base = vectors(spark, [(1, [0.0, 1.0]), (0, [1.0, 0.0]), (2, [2.0, 0.0])])
    q = vectors(spark, [(9, [0.0, 0.0])])
    assert [r.key for r in search.linear_search(base, q, 1, "l2norm").collect()] == [0]
    assert search.linear_search(base, q, 0, "l2norm").count() == 0
    assert [tuple(r) for r in search.linear_search(base, q, 99, "l2norm").orderBy("rank").collect()] == [(1, 1.0, 0), (2, 1.0, 1), (3, 2.0, 2)]


def test_knn_leaves_out_nulls_and_nans(spark):
    base = vectors(spark, [(0, None), (1, [float("nan")]), (2, [3.0]), (3, [])])
    assert [r.key for r in search.linear_search(base, vectors(spark, [(9, [0.0])]), 5, "l1norm").collect()] == [2]
    assert search.linear_search(base.limit(0), vectors(spark, [(9, [0.0])]), 5, "l1norm").count() == 0


def test_batched_equals_single(spark):
    base = vectors(spark, [(i, [float(i % 5), float(i // 5)]) for i in range(20)])
    batch = search.batched_search(base, base.selectExpr("key as query", "vector"), 3, "l2norm").collect()
    for i in range(20):
        one = search.linear_search(base, base.filter(f"key = {i}"), 3, "l2norm").collect()
        assert sorted((r.rank, r.key) for r in batch if r["query"] == i) == sorted((r.rank, r.key) for r in one)


def test_merge_keeps_the_nearest(spark):
    a = spark.createDataFrame([(1, 0.5, 3), (2, 0.7, 1)], "rank int, distance double, key long")
    b = spark.createDataFrame([(1, 0.5, 2), (2, 0.7, 1)], "rank int, distance double, key long")
    assert [r.key for r in search.merge_results(a, b, 2).orderBy("rank").collect()] == [2, 3]


def made(spark, rows, n, tf="lucene", idf="lucene"):
    p = spark.createDataFrame(rows, "doc_id long, term_id long, f double")
    return index.apply_tfidf(index.build_index(p, spark.range(n).withColumnRenamed("id", "doc_id")), tf, idf)


def ask(spark, ix, terms, k, tf="lucene", idf="lucene"):
    q = spark.createDataFrame(terms, "term_id long, f double")
    return [(r.doc_id, r.score) for r in index.query_index(ix, q, k, tf, idf).orderBy("rank").collect()]


def test_index_tie_goes_to_the_higher_document(spark):
    ix = made(spark, [(0, 1, 2.0), (1, 1, 2.0)], 2)
    assert ask(spark, ix, [(1, 2.0)], 1)[0][0] == 1


def test_documents_without_shared_terms_are_listed(spark):
    ix = made(spark, [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)], 3)
    assert ask(spark, ix, [(2, 1.0)], 3) == [(1, 1.0), (2, 0.0), (0, 0.0)]


@pytest.mark.parametrize(("name", "zero"), [("simple", True), ("video_google", True), ("lucene", False), ("constant", False)])
def test_unknown_term(spark, name, zero):
    ix = made(spark, [(0, 1, 1.0), (1, 2, 1.0), (2, 1, 1.0), (2, 2, 3.0)], 3, name, name)
    scores = [s for _, s in ask(spark, ix, [(1, 1.0), (99, 1.0)], 3, name, name)]
    assert (max(scores) == 0) == zero


def test_unit_length_and_idf_zero(spark):
    ix = made(spark, [(0, 1, 3.0), (0, 2, 1.0), (1, 2, 5.0)], 2)
    for d in (0, 1):
        assert isclose(sqrt(sum(r.w**2 for r in ix.postings.filter(f"doc_id = {d}").collect())), 1)
    assert [r.w for r in made(spark, [(0, 1, 1.0)], 1, "video_google", "video_google").postings.collect()] == [0.0]


def test_save_and_load(spark, tmp_path):
    ix = made(spark, [(0, 1, 3.0), (1, 2, 5.0)], 3)
    ix.save(str(tmp_path))
    assert ask(spark, index.InvertedIndex.load(spark, str(tmp_path)), [(1, 1.0)], 1) == [(0, 1.0)]


def test_empty_index(spark):
    ix = made(spark, [], 0)
    assert ask(spark, ix, [(1, 1.0)], 3) == []
    assert ix.meta.first().n_docs == 0


def test_sparse_skips_zero_bins(spark):
    h = spark.createDataFrame([(0, [0.0, -1.0, 2.0]), (1, None), (2, [])], "doc_id long, histogram array<double>")
    assert sorted(tuple(r) for r in index.sparse(h).collect()) == [(0, 1, -1.0), (0, 2, 2.0)]
