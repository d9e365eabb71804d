"""The newest row of every key, without moving the wide columns of keys that have one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenary.session import maybe_broadcast


def latest_rows(df: DataFrame, key: str, order: str, keep: list[str]) -> DataFrame:
    """One row per non-null `key`: the one with the greatest `order`; columns key and `keep`.

    Equal `order` (exact repeats) gives one of the equal rows, chosen by their content's hash. A null `order` counts
    as oldest. Rows with a null key are dropped. An empty table gives an empty result.
    Only keys with several rows go through a shuffle with their wide columns; they are found by a narrow aggregate.
    """
    df = df.filter(F.col(key).isNotNull())
    several = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(key)
    several = maybe_broadcast(several)
    single = df.join(several, key, "left_anti").select(key, *keep)
    content = F.xxhash64(*[F.col(c) for c in keep])
    w = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last(), F.col("_h"))
    many = (
        df.join(several, key, "left_semi")
        .select(key, order, *[c for c in keep if c not in (key, order)], content.alias("_h"))
        .withColumn("_r", F.row_number().over(w))
        .filter("_r = 1")
        .select(key, *keep)
    )
    return single.unionByName(many)
