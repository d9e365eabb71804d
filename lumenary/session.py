"""Session helpers: the shared checkpoint folder and broadcasts of a checked size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow side (a few numbers a row) is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    held = getattr(spark, "_lumenary_dir", None)
    if held is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        held = "file://" + tempfile.mkdtemp(prefix="lumenary-")
        spark._lumenary_dir = held
        spark.sparkContext.setCheckpointDir(held)
    return held


def materialise(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lumenary-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._lumenary_path = path
    return back


def forget(df: DataFrame) -> None:
    """Delete the files of a materialised table that no later step reads."""
    path = getattr(df, "_lumenary_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is proven to have at most `limit` rows, else unchanged.

    Counts at most limit + 1 rows; meant for narrow tables whose plan is cheap.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
