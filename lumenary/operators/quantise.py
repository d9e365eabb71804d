"""Vector quantisation and histograms of visual words, with spatial pyramids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def feature_rows(images: DataFrame, dim: int, image: str = "image_id") -> DataFrame:
    """(image_id, n, feature ARRAY<DOUBLE>, x, y) of the usable features of rows with features and positions.

    Usable: exactly `dim` finite values that are not all zero. Missing positions are null.
    """
    rows = images.select(image, "positions", F.posexplode("features").alias("n", "feature"))
    finite = F.forall("feature", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("feature", lambda v: v != 0)
    at = F.get("positions", F.col("n"))
    return rows.filter((F.size("feature") == dim) & finite).select(image, "n", F.col("feature").cast("array<double>").alias("feature"), F.get(at, F.lit(0)).cast("double").alias("x"), F.get(at, F.lit(1)).cast("double").alias("y"))


def _words(vocabulary: DataFrame, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """(word ids ascending, centers): small enough to be sent to every worker, else an error. Null or unequal centers are left out."""
    rows = sorted((r.word_id, r.center) for r in vocabulary.filter("word_id is not null and center is not null").select("word_id", "center").limit(most + 1).collect())
    if len(rows) > most:
        raise ValueError(f"the vocabulary has more than {most} words")
    rows = [(w, c) for w, c in rows if len(c) == len(rows[0][1]) and all(v is not None for v in c)]
    return np.array([w for w, _ in rows], np.int32), np.array([c for _, c in rows], np.float64).reshape(len(rows), len(rows[0][1]) if rows else 0)


def _squared(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ centers.T) + (centers * centers).sum(axis=1), 0)


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, matrix) of the lists that have `dim` finite elements."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == dim)
    x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
    ok = np.isfinite(x).all(axis=1)
    return at[ok], x[ok]


def quantise_hard(features: DataFrame, vocabulary: DataFrame, keys: list[str]) -> DataFrame:
    """keys, word_id INT, weight 1.0: the nearest word of each feature (squared L2, rounded to 9 decimals), ties to the last word.

    Features that are null, of another length or not finite have no row; without words there are no rows.
    The vocabulary goes to every worker as one matrix; a batch is one matrix product.
    """
    ids, centers = _words(vocabulary)
    chosen = features.select(*keys, "feature")
    schema = T.StructType([*chosen.drop("feature").schema.fields, T.StructField("word_id", T.IntegerType()), T.StructField("weight", T.DoubleType())])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(ids):
                continue
            at, x = _matrix(b.column("feature"), centers.shape[1])
            if len(at):
                d = _squared(x, centers).round(9)[:, ::-1]
                word = ids[len(ids) - 1 - d.argmin(axis=1)]
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(at)) for k in keys), pa.array(word), pa.array(np.ones(len(at)))], [*keys, "word_id", "weight"])

    return chosen.mapInArrow(nearest, schema)


def quantise_fuzzy(features: DataFrame, vocabulary: DataFrame, keys: list[str], sigma: float) -> DataFrame:
    """keys, word_id INT, weight: exp(-d^2 / (2 sigma^2)) of the squared L2 distance d, scaled to sum 1 over the words.

    sigma must be positive. Words whose weight underflows to 0 have no row; features as in quantise_hard.
    """
    if not sigma > 0:
        raise ValueError("sigma must be positive")
    ids, centers = _words(vocabulary)
    chosen = features.select(*keys, "feature")
    schema = T.StructType([*chosen.drop("feature").schema.fields, T.StructField("word_id", T.IntegerType()), T.StructField("weight", T.DoubleType())])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(ids):
                continue
            every, x = _matrix(b.column("feature"), centers.shape[1])
            for i in range(0, len(every), 1024):
                e = np.exp(-(_squared(x[i : i + 1024], centers) ** 2) / (2 * sigma * sigma))
                total = e.sum(axis=1, keepdims=True)
                e = np.divide(e, total, out=np.zeros_like(e), where=total > 0)
                row, word = np.nonzero(e)
                at = pa.array(every[i : i + 1024][row])
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in keys), pa.array(ids[word]), pa.array(e[row, word])], [*keys, "word_id", "weight"])

    return chosen.mapInArrow(weigh, schema)


def histograms(quantised: DataFrame, words: int, levels: int = 1, fuzzy: bool = False, image: str = "image_id") -> DataFrame:
    """(image_id, bin, f): sums of weights by word and cell of a spatial pyramid; bins without weight have no row.

    quantised: image_id, n, word_id, weight, x, y. Level j has 2^j x 2^j cells; its bins begin at words * (4^j - 1) / 3,
    cell (cx, cy) at words * (2^j * cy + cx) within it; positions at 1 belong to the last cell. Levels have no weights of
    their own. fuzzy: each level is divided by the image's number of features. Features without a position count in level 0 only.
    """
    rows = quantised
    if fuzzy:
        rows = rows.withColumn("_n", F.size(F.collect_set("n").over(Window.partitionBy(image))))
    rows = rows.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    res = F.pow(F.lit(2), F.col("_j"))
    cell = [F.when(F.col("_j") == 0, 0).otherwise(F.least(F.floor(F.col(p) * res), res - 1)) for p in ("x", "y")]
    base = (F.pow(F.lit(4), F.col("_j")) - 1) / 3 * words
    at = (base + words * (res * cell[1] + cell[0]) + F.col("word_id")).cast("long")
    f = F.col("weight") / F.col("_n") if fuzzy else F.col("weight")
    return rows.select(image, at.alias("bin"), f.alias("f")).filter("bin is not null and f <> 0").groupBy(image, "bin").agg(F.sum("f").alias("f"))


def dense(rows: DataFrame, images: DataFrame, words: int, levels: int = 1, image: str = "image_id") -> DataFrame:
    """(image_id, histogram ARRAY<DOUBLE>): dense histograms; an image without features has all zeros."""
    size = words * (4**levels - 1) // 3
    maps = rows.groupBy(image).agg(F.map_from_entries(F.collect_list(F.struct("bin", "f"))).alias("_m"))
    every = images.select(image).distinct().join(maps, image, "left")
    return every.select(image, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("_m", i.cast("long")), F.lit(0.0))).alias("histogram"))
