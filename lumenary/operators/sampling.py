"""Seeded samples, file lists, view-to-model mapping, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def sample_rows(df: DataFrame, n: int, keys: list[str], seed: int = 0) -> DataFrame:
    """A uniform sample of min(n, all) rows: those first in the order of md5(seed:keys). Repeated keys are separate rows."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))
    return df.withColumn("_h", h).orderBy("_h", *keys).limit(max(0, n)).drop("_h")


def list_files(spark: SparkSession, root: str, globs: list[str] | None = None) -> DataFrame:
    """(image_id, rel_path) of the files under root whose names match a glob; ids follow the sorted path, so they repeat from run to run."""
    base = root.rstrip("/")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", "{" + ",".join(globs) + "}") if globs else reader
    files = reader.load(base).select("path")
    rel = F.regexp_replace("path", "^(file:)?/*" + base.removeprefix("file:").strip("/") + "/", "")
    return ordinal(files.select(rel.alias("rel_path")), "rel_path", "image_id")


def ordinal(df: DataFrame, order: str | list[Column], name: str) -> DataFrame:
    """df with 0-based positions in the order of `order`: a range sort, one count a partition, then a running offset."""
    by = [F.col(order)] if isinstance(order, str) else order
    parts = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))  # one row a partition
    return parts.join(F.broadcast(offsets), "_p").select((F.col("_before") + F.col("_i") - F.col("_first")).alias(name), *df.columns)


def parent_dir(path: Column) -> Column:
    """The path up to its last slash; '' for a bare name."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def view_model_mapping(views: DataFrame, models: DataFrame, strict: bool = True) -> DataFrame:
    """(view_idx, model_idx): each view's model is the one in its directory.

    views, models: idx, path. strict: two models in one directory, or a view without a model, are errors; else such
    views get the lowest model, or null. Rows with a null path are left out.
    """
    m = models.filter("path is not null").select(parent_dir(F.col("path")).alias("dir"), "idx").groupBy("dir").agg(F.min("idx").alias("model_idx"), F.count(F.lit(1)).alias("_n"))
    v = views.filter("path is not null").select(F.col("idx").alias("view_idx"), parent_dir(F.col("path")).alias("dir"))
    out = v.join(m, "dir", "left")
    model = F.col("model_idx")
    if strict:
        model = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("several models in "), "dir")).cast("long")).otherwise(F.coalesce(model, F.raise_error(F.concat(F.lit("no model in "), "dir")).cast("long")))
    return out.select("view_idx", model.alias("model_idx"))


def normalise_positions(df: DataFrame, width: Column, height: Column) -> DataFrame:
    """df with x and y divided by the size; null where the size is 0."""
    return df.withColumns({"x": F.try_divide(F.col("x"), width), "y": F.try_divide(F.col("y"), height)})


def filter_empty(df: DataFrame, empty: str) -> DataFrame:
    """The (feature, position) rows whose flag `empty` is false; a null flag counts as empty."""
    return df.filter(~F.coalesce(F.col(empty), F.lit(True)))


def grid_points(spark: SparkSession, width: int, height: int, n: int = 625) -> DataFrame:
    """(n, x, y): ceil(sqrt(n))^2 points on a grid inside the image, x-major, cut to whole pixels."""
    side = int(-(-(n**0.5) // 1))
    i = F.col("id")
    x, y = F.floor((F.floor(i / side) + 1) * width / (side + 1)), F.floor((i % side + 1) * height / (side + 1))
    return spark.range(side * side).select(i.cast("int").alias("n"), x.cast("int").alias("x"), y.cast("int").alias("y"))


def random_points(images: DataFrame, n: int = 500, seed: int = 0) -> DataFrame:
    """(image_id, n, x, y): n hash-seeded points in each image (image_id, width, height)."""
    rows = images.select("image_id", "width", "height", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("n"))

    def within(size: str, salt: int) -> Column:
        return F.pmod(F.xxhash64("image_id", "n", F.lit(seed), F.lit(salt)), F.col(size).cast("long")).cast("int")

    return rows.filter("width > 0 and height > 0").select("image_id", "n", within("width", 1).alias("x"), within("height", 2).alias("y"))
