"""Every distance against hand-computed values, with zeros and edge cases."""

from math import log, sqrt

import pytest
from pyspark.sql import functions as F

from lumenary.functions import distances

CASES = [
    ("l1norm", [1, 2], [3, 1], 3.0),
    ("l2norm_squared", [1, 2], [3, 1], 5.0),
    ("l2norm", [1, 2], [3, 1], sqrt(5)),
    ("one_minus_dot", [1, 0], [0.5, 3], 0.5),
    ("jsd", [0, 1], [0, 1], 0.0),
    ("jsd", [1, 0], [0, 1], 2 * log(2)),
    ("chi2", [1, 0], [0, 1], 2 / (1 + 1.1920929e-07)),
    ("chi2", [0, 1], [0, 1], 0.0),
    ("frobenius", [1, 2, 3, 0, 0, 0], [0, 0, 0, 0, 1, 0], sqrt(1 + 8 + 9) + sqrt(2)),
    ("df", [1, 2, 3, 4], [5, 6, 7, 8], 1 * 7 + 2 * 8 + 5 * 3 + 6 * 4),
    ("l1norm", [], [], 0.0),
]


@pytest.mark.parametrize(("name", "a", "b", "value"), CASES)
def test_value(spark, name, a, b, value):
    df = spark.createDataFrame([([float(x) for x in a], [float(x) for x in b])], "a array<double>, b array<double>")
    assert df.select(distances.distance(name)(F.col("a"), F.col("b"))).first()[0] == pytest.approx(value)


def test_mask_leaves_triples_out(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 0.0, 1.0, 0.0], [True, False])], "a array<double>, b array<double>, m array<boolean>")
    assert df.select(distances.frobenius(F.col("m"))(F.col("a"), F.col("b"))).first()[0] == pytest.approx(sqrt(2))


def test_null_and_short_vectors_have_no_distance(spark):
    df = spark.createDataFrame([(None, [1.0]), ([1.0], None), ([1.0, 2.0], [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(distances.l1norm(F.col("a"), F.col("b"))).collect()] == [None, None, None]


def test_unknown_name():
    with pytest.raises(ValueError, match="unknown distance"):
        distances.distance("cosine")
