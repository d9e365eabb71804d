"""Exact nearest neighbours: one query, a batch of queries, and merging of partial results."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenary.functions.distances import Distance, distance
from lumenary.functions.matrix import MATRIX
from lumenary.operators.sampling import ordinal
from lumenary.session import materialise

#: Decimals to which distances and scores are rounded before they are ordered, so that equal ones tie in every engine.
DECIMALS = 9
#: Queries of a block that goes to every worker; results from which ranks are given by range partitions instead of one task.
QUERIES, RANKED = 10_000, 100_000


def ranked(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows in that order, with `rank` from 1."""
    if k <= RANKED:
        return rows.orderBy(*order).limit(max(0, k)).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # k rows
    # ordinal reads its rows twice
    return ordinal(materialise(rows), list(order), "_at").filter(F.col("_at") < k).withColumn("rank", (F.col("_at") + 1).cast("int")).drop("_at")


def linear_search(base: DataFrame, query: DataFrame, k: int, dist: str | Distance, key: str = "key", vector: str = "vector") -> DataFrame:
    """(rank INT, distance, key): the k rows of `base` nearest to the one row of `query`; ties go to the lower key.

    Rows whose distance is null or NaN (null vectors, other lengths) are left out; k beyond the rows gives all, k = 0 none.
    The query is one row, so it is broadcast; the plan is a scan, a projection and a per-partition top-k.
    """
    f = distance(dist) if isinstance(dist, str) else dist
    one = F.broadcast(query.limit(1).select(F.col(vector).alias("_q")))
    near = base.select(key, F.col(vector).alias("_v")).crossJoin(one).select(F.round(f(F.col("_q"), F.col("_v")), DECIMALS).alias("distance"), key)
    near = near.filter(F.col("distance").isNotNull() & ~F.isnan("distance"))
    return ranked(near, k, F.col("distance"), F.col(key)).select("rank", "distance", key)


def batched_search(base: DataFrame, queries: DataFrame, k: int, dist: str | Distance, key: str = "key", vector: str = "vector", query_key: str = "query") -> DataFrame:
    """(query, rank, distance, key): as linear_search for each row of `queries` (query_key, vector).

    Queries go to every worker in blocks of about QUERIES rows, each of which reads the base once; a task keeps its own best k a query. Named
    distances of `functions.matrix` are computed as matrices in Arrow batches, others as expressions.
    """
    queries = materialise(queries.filter(F.col(vector).isNotNull()).select(query_key, F.col(vector).alias("_q")))
    parts = max(1, -(-queries.count() // QUERIES))
    w = Window.partitionBy(query_key).orderBy("distance", key)
    base = base.select(key, F.col(vector).alias("_v"))
    found = []
    for i in range(parts):
        block = queries.filter(F.pmod(F.xxhash64(query_key), F.lit(parts)) == i) if parts > 1 else queries
        if isinstance(dist, str) and dist in MATRIX:
            found.append(_in_batches(base, block, k, dist, key, query_key))
            continue
        f = distance(dist) if isinstance(dist, str) else dist
        near = base.join(F.broadcast(block), F.lit(True))  # a block
        found.append(near.select(query_key, F.round(f(F.col("_q"), F.col("_v")), DECIMALS).alias("distance"), key))
    near = reduce(DataFrame.unionByName, found)
    near = near.filter(F.col("distance").isNotNull() & ~F.isnan("distance"))
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(query_key, "rank", "distance", key)


def _in_batches(base: DataFrame, block: DataFrame, k: int, dist: str, key: str, query_key: str) -> DataFrame:
    """(query_key, distance, key): the best k of each task for each of the block's queries; queries of another length than a base row don't meet it."""
    held = block.toArrow()  # a block
    ids, vectors = held.column(query_key), held.column("_q").to_pylist()
    dims = sorted({len(v) for v in vectors if all(x is not None for x in v)})
    of_dim = {d: np.array([i for i, v in enumerate(vectors) if len(v) == d and all(x is not None for x in v)]) for d in dims}
    matrix = {d: np.array([vectors[i] for i in at], np.float64).reshape(len(at), d) for d, at in of_dim.items()}
    f = MATRIX[dist]
    kinds = {query_key: block.schema[query_key].dataType.simpleString(), key: base.schema[key].dataType.simpleString()}

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pa.Table | None = None
        for b in batches:
            lists = b.column("_v")
            lengths = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            parts = [] if best is None else [best]
            for d, q in matrix.items():
                at = np.flatnonzero(lengths == d)
                for i in range(0, len(at), 2048):
                    own = at[i : i + 2048]
                    x = lists.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), d)
                    m = f(x, q).round(DECIMALS)
                    row, column = np.nonzero(np.isfinite(m))
                    if k < len(own):  # what is farther than the k-th can't be among the best
                        bound = np.partition(np.where(np.isfinite(m), m, np.inf), k - 1, axis=0)[k - 1] if k > 0 else np.full(len(q), -np.inf)
                        on = m[row, column] <= bound[column]
                        row, column = row[on], column[on]
                    parts.append(pa.table({"q": of_dim[d][column], "distance": m[row, column], "key": b.column(key).take(pa.array(own[row]))}))
            if parts:
                whole = pa.concat_tables(parts).sort_by([("q", "ascending"), ("distance", "ascending"), ("key", "ascending")])
                q = whole.column("q").to_numpy()
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                best = whole.filter(pa.array(rank < k))
        if best is not None and len(best):
            for part in best.to_batches():
                yield pa.RecordBatch.from_arrays([ids.combine_chunks().take(part.column("q")), part.column("distance"), part.column("key")], [query_key, "distance", key])

    return base.mapInArrow(near, f"`{query_key}` {kinds[query_key]}, distance double, `{key}` {kinds[key]}")


def merge_results(old: DataFrame, new: DataFrame, k: int, key: str = "key") -> DataFrame:
    """(rank, distance, key): the k nearest of two results (rank is made anew); a key in both counts once."""
    both = old.select("distance", key).unionByName(new.select("distance", key)).groupBy(key).agg(F.min("distance").alias("distance"))
    return ranked(both, k, F.col("distance"), F.col(key)).select("rank", "distance", key)


def with_filenames(results: DataFrame, files: DataFrame, key: str, file_key: str, root: str | Column | None = None) -> DataFrame:
    """results with `rel_path` (and `filename` under `root`) of each key; a key without a file keeps null."""
    named = results.join(files.select(F.col(file_key).alias(key), "rel_path"), key, "left")
    return named if root is None else named.withColumn("filename", full_name(root, F.col("rel_path")))


def full_name(root: str | Column, rel_path: Column) -> Column:
    """root / rel_path; null if either is."""
    return F.concat(F.lit(root) if isinstance(root, str) else root, F.lit("/"), rel_path)
