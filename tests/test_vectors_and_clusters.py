"""Quantisation, pyramids, k-means rules, newest rows, samples, mapping."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenary.operators import kmeans, quantise, sampling
from lumenary.operators.latest import latest_rows


def features(spark, rows):
    return spark.createDataFrame(rows, "image_id long, n int, feature array<double>, x double, y double")


def words(spark, rows):
    return spark.createDataFrame(rows, "word_id int, center array<double>")


def test_hard_tie_goes_to_the_last_word_and_kmeans_to_the_first(spark):
    f = features(spark, [(0, 0, [0.0], 0.0, 0.0), (0, 1, None, 0.0, 0.0), (0, 2, [float("nan")], 0.0, 0.0)])
    assert [r.word_id for r in quantise.quantise_hard(f, words(spark, [(0, [-1.0]), (1, [1.0])]), ["image_id", "n"]).collect()] == [1]
    s = spark.createDataFrame([(0, [0.0])], "key long, vector array<double>")
    c = spark.createDataFrame([(0, [-1.0]), (1, [1.0])], "cluster int, center array<double>")
    assert kmeans.assign(s, c).first().cluster == 0
    assert quantise.quantise_hard(f, words(spark, []), ["image_id"]).count() == 0


def test_fuzzy_weights(spark):
    f = features(spark, [(0, 0, [0.0], 0.0, 0.0), (0, 1, [1e6], 0.0, 0.0)])
    got = quantise.quantise_fuzzy(f, words(spark, [(0, [0.0]), (1, [1.0])]), ["n"], 1.0).collect()
    e = np.exp([0, -0.5])
    assert sorted((r.n, r.word_id, round(r.weight, 9)) for r in got) == [(0, 0, round(e[0] / e.sum(), 9)), (0, 1, round(e[1] / e.sum(), 9))]
    with pytest.raises(ValueError, match="positive"):
        quantise.quantise_fuzzy(f, words(spark, []), ["n"], 0)


def test_grid_edges_and_pyramid_sums(spark):
    q = spark.createDataFrame([(0, 0, 0, 1.0, 1.0, 1.0), (0, 1, 0, 1.0, 0.5, 0.5), (0, 2, 0, 1.0, 0.0, 0.0)], "image_id long, n int, word_id int, weight double, x double, y double")
    rows = {r.bin: r.f for r in quantise.histograms(q, 1, levels=2).collect()}
    assert rows == {0: 3.0, 1: 1.0, 4: 2.0}
    d = quantise.dense(quantise.histograms(q, 1, levels=2), spark.createDataFrame([(0,), (7,)], "image_id long"), 1, 2)
    assert {r.image_id: r.histogram for r in d.collect()} == {0: [3.0, 1.0, 0.0, 0.0, 2.0], 7: [0.0] * 5}


def run(spark, values, centers, share, **more):
    s = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate(values)], "key long, vector array<double>")
    c, a, n = kmeans.kmeans(s, len(centers), min_changes=share, centers=np.array(centers, float)[:, None], **more)
    return c[:, 0], [r.cluster for r in a.orderBy("key").collect()], n


def test_empty_cluster_is_repaired(spark):
    c, a, n = run(spark, [0, 0, 4, 10], [0, 0, 10], 0)
    assert np.allclose(c, [4 / 3, 4, 10])
    assert (a, n) == ([0, 0, 1, 2], 2)


def test_stop_before_the_centers_move(spark):
    c, a, n = run(spark, [0, 1, 10, 11, 5], [0, 1], 0.3)
    assert np.allclose(c, [0, 6.75])
    assert a == [0, 0, 1, 1, 1]
    assert run(spark, [0, 0, 10], [0, 10], 0.01)[2] == 1


def test_seeding(spark):
    s = spark.createDataFrame([(i, [float(i // 3 * 100)]) for i in range(9)], "key long, vector array<double>")
    assert sorted(r.center[0] for r in kmeans.initial_plusplus(s, 3).collect()) == [0.0, 100.0, 200.0]
    assert kmeans.initial_plusplus(s, 9).count() == 3
    with pytest.raises(ValueError, match="fewer"):
        kmeans.initial_random(s, 10)


def test_newest_row(spark):
    df = spark.createDataFrame([(1, 5, "a", 0), (1, 7, "b", 1), (1, 7, "b", 1), (2, None, "c", 2), (None, 1, "d", 3), (3, None, "e", 4), (3, 1, "f", 5)], "image_id long, t int, v string, _n int")
    got = latest_rows(df, "image_id", "t", ["v"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, "b"), (2, "c"), (3, "f")]
    assert latest_rows(df.limit(0), "image_id", "t", ["v"]).count() == 0


def test_samples_repeat_and_cover(spark):
    df = spark.range(100)
    one, two = sampling.sample_rows(df, 10, ["id"], 1).collect(), sampling.sample_rows(df.repartition(7), 10, ["id"], 1).collect()
    assert sorted(one) == sorted(two)
    assert len(one) == 10
    assert sampling.sample_rows(df, 1000, ["id"]).count() == 100


def test_mapping_failures(spark):
    v = spark.createDataFrame([(1, "a/x.png"), (2, "b/y.png"), (3, None)], "idx long, path string")
    m = spark.createDataFrame([(7, "a/m.off")], "idx long, path string")
    assert sorted(tuple(r) for r in sampling.view_model_mapping(v, m, strict=False).collect()) == [(1, 7), (2, None)]
    with pytest.raises(Exception, match="no model in b"):
        sampling.view_model_mapping(v, m).collect()
    with pytest.raises(Exception, match="several models in a"):
        sampling.view_model_mapping(v.filter("idx = 1"), m.unionByName(m), strict=True).collect()


def test_file_list_and_points(spark, tmp_path):
    for name in ("b.png", "a.jpg", "sub/c.png", "d.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    files = sampling.list_files(spark, str(tmp_path), ["*.png", "*.jpg"])
    assert [tuple(r) for r in files.orderBy("image_id").collect()] == [(0, "a.jpg"), (1, "b.png"), (2, "sub/c.png")]
    assert sampling.grid_points(spark, 10, 10, 10).count() == 16
    got = sampling.random_points(spark.createDataFrame([(1, 5, 3), (2, 0, 3)], "image_id long, width int, height int"), 50)
    assert got.filter("x >= 0 and x < 5 and y >= 0 and y < 3 and image_id = 1").count() == got.count() == 50


def test_positions(spark):
    df = spark.createDataFrame([(1, 10.0, 4.0, 20, 0)], "n int, x double, y double, w int, h int")
    assert tuple(sampling.normalise_positions(df, F.col("w"), F.col("h")).select("x", "y").first()) == (0.5, None)
