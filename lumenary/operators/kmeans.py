"""Lloyd's k-means with a stop by changes and repair of empty clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenary.functions.distances import l2norm_squared
from lumenary.functions.matrix import MatrixDistance, matrix_distance


def assign(samples: DataFrame, centers: DataFrame, key: str = "key") -> DataFrame:
    """(key, vector, cluster, d): the nearest center (squared L2, 9 decimals) of each sample, ties to the first. Null vectors are left out."""
    words = F.broadcast(centers.agg(F.sort_array(F.collect_list(F.struct("cluster", F.col("center").cast("array<double>").alias("center")))).alias("_c")))  # k rows
    d = F.transform("_c", lambda c: F.struct(F.round(l2norm_squared(F.col("vector"), c["center"]), 9).alias("d"), c["cluster"].alias("c")))
    return samples.filter("vector is not null").crossJoin(words).select(key, "vector", F.array_min(d).alias("_m")).select(key, "vector", F.col("_m.c").alias("cluster"), F.col("_m.d").alias("d"))


def means(assigned: DataFrame) -> DataFrame:
    """(cluster, center ARRAY<DOUBLE>): the mean of each cluster's vectors: sums and counts of each task, added up. Vectors must have one length."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                x = np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                which, place = np.unique(np.asarray(b.column(0)), return_inverse=True)
                total = np.zeros((len(which), x.shape[1] + 1))
                np.add.at(total, place, np.c_[x, np.ones(len(x))])
                for c, v in zip(which.tolist(), total, strict=True):
                    sums[c] = sums[c] + v if c in sums else v
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["cluster", "sums"])

    def merge(t: pa.Table) -> pa.Table:
        total = np.sum(np.array(t.column("sums").to_pylist()), axis=0)
        return pa.table({"cluster": t.column("cluster")[:1], "center": pa.array([(total[:-1] / total[-1]).tolist()], pa.list_(pa.float64()))})

    kind = assigned.schema["cluster"].dataType.simpleString()
    partial = assigned.select(F.col("cluster").cast("long").alias("cluster"), "vector").mapInArrow(add, "cluster long, sums array<double>")
    return partial.groupBy("cluster").applyInArrow(merge, "cluster long, center array<double>").select(F.col("cluster").cast(kind).alias("cluster"), "center")


def cluster_table(assigned: DataFrame, key: str = "key") -> DataFrame:
    """(cluster, size, variance = sum of d^2 / size, farthest): farthest is the member of greatest d, ties to the first."""
    return assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.avg(F.col("d") * F.col("d")).alias("variance"), F.max_by(key, F.struct("d", -F.col(key))).alias("farthest"))


def members(assigned: DataFrame, key: str = "key") -> DataFrame:
    """(cluster, key): the cluster's members as rows, in no order; arrays of them would not scale."""
    return assigned.select("cluster", key)


def initial_random(samples: DataFrame, k: int, seed: int = 0, key: str = "key") -> DataFrame:
    """(cluster, center): k different samples, those first in the order of md5(seed:key). Fewer than k samples are an error."""
    chosen = samples.filter("vector is not null").select(key, "vector", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))).alias("_h")).orderBy("_h", key).limit(k)
    chosen = chosen.select((F.row_number().over(Window.orderBy("_h", key)) - 1).alias("cluster"), F.col("vector").cast("array<double>").alias("center"))  # k rows
    if chosen.count() < k:
        raise ValueError("there are fewer samples than clusters")
    return chosen


def initial_plusplus(samples: DataFrame, k: int, seed: int = 0, key: str = "key", trials: int | None = None, distance: str | MatrixDistance = "l2norm_squared") -> DataFrame:
    """(cluster, center): k-means++ seeding; of `trials` (2 + ln k if not given) next centers, drawn with probability d^2 / sum(d^2), d^2 the squared L2 distance
    (or `distance`) to the nearest center so far, the one that leaves the least sum is taken, ties to the first drawn.

    The draw is the least -ln(u) / d^2 with u from a hash of seed, round and key; a task sends its own `trials` least only.
    If all samples coincide with centers, fewer than k centers result.
    """
    spark = samples.sparkSession
    trials, f = trials or 2 + int(log(max(1, k))), matrix_distance(distance)
    rows = samples.filter("vector is not null").select(key, F.col("vector").cast("array<double>").alias("vector"))
    chosen = [np.array(r.vector) for r in rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:0:"), F.col(key).cast("string"))), key).limit(1).collect()]
    while chosen and len(chosen) < k:
        at = np.stack(chosen)
        u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(len(chosen)), key), F.lit(2**52)) + 1) / F.lit(float(2**52 + 1))

        def draw(batches: Iterator[pa.RecordBatch], at: np.ndarray = at) -> Iterator[pa.RecordBatch]:
            held: list[tuple[float, list[float]]] = []
            for b in batches:
                if b.num_rows:
                    x = np.stack(b.column(0).to_numpy(zero_copy_only=False))
                    d = f(x, at).min(axis=1)
                    on = np.flatnonzero(d > 0)
                    race = -np.log(np.asarray(b.column(1))[on]) / d[on]
                    held += [(float(race[i]), x[on[i]].tolist()) for i in np.argsort(race, kind="stable")[:trials]]
                    held = sorted(held)[:trials]
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in held]), pa.array([v for _, v in held], pa.list_(pa.float64()))], ["race", "vector"])

        drawn = rows.select("vector", u.alias("u")).mapInArrow(draw, "race double, vector array<double>").orderBy("race", "vector").limit(trials).collect()
        if not drawn:
            break
        candidates = np.array([r.vector for r in drawn])

        def left(batches: Iterator[pa.RecordBatch], at: np.ndarray = at, candidates: np.ndarray = candidates) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(candidates))
            for b in batches:
                if b.num_rows:
                    x = np.stack(b.column(0).to_numpy(zero_copy_only=False))
                    total += np.minimum(f(x, at).min(axis=1)[:, None], f(x, candidates)).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(candidates))), pa.array(total)], ["i", "total"])

        best = 0
        if len(candidates) > 1:
            sums = rows.select("vector").mapInArrow(left, "i long, total double").groupBy("i").agg(F.sum("total").alias("total")).collect()
            best = min(sums, key=lambda r: (round(r.total, 9), r.i)).i
        chosen.append(candidates[best])
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(chosen)], "cluster int, center array<double>")


def potential(samples: DataFrame, centers: DataFrame, key: str = "key") -> DataFrame:
    """(potential): the sum of squared distances to the nearest center."""
    return assign(samples, centers, key).agg(F.sum("d").alias("potential"))


def _spread(assigned: DataFrame, centers: np.ndarray, moved: dict[int, int], key: str, f: MatrixDistance) -> dict[int, tuple[float, int, list[float]]]:
    """cluster -> (sum of d^2, farthest member, its vector), d the distance to the member's own center."""
    kind = assigned.schema[key].dataType.simpleString()

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = np.array([moved.get(k, c) for k, c in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)], np.int32)
                x = np.stack(b.column(1).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(c), pa.array(_own(f, x, centers, c))], [key, "vector", "cluster", "d"])

    rows = assigned.select(key, "vector", "cluster").mapInArrow(own, f"`{key}` {kind}, vector array<double>, cluster int, d double")
    far = F.max_by(F.struct(F.col(key).alias("key"), "vector"), F.struct("d", -F.col(key)))
    return {r.cluster: (r.spread, r.far.key, r.far.vector) for r in rows.groupBy("cluster").agg(F.sum(F.col("d") * F.col("d")).alias("spread"), far.alias("far")).collect()}


def _own(f: MatrixDistance, x: np.ndarray, centers: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The distance of each row to its own center."""
    d = np.empty(len(x))
    for i in np.unique(c):
        at = np.flatnonzero(c == i)
        d[at] = f(x[at], centers[i : i + 1])[:, 0]
    return d


def _repair(assigned: DataFrame, centers: np.ndarray, size: np.ndarray, key: str, f: MatrixDistance) -> tuple[np.ndarray, dict[int, int]]:
    """(centers, moved samples): each empty cluster, last first, is put on the farthest member of the cluster with the
    greatest sum of d^2 / size, which moves to it; then the last of the clusters that had members is no donor any more,
    whichever the donor was. Where no member is away from its center, the rest stay empty."""
    centers, moved = centers.copy(), {}
    valid = [i for i in range(len(size)) if size[i]]
    for e in reversed([i for i in range(len(size)) if not size[i]]):
        spread = _spread(assigned, centers, moved, key, f)
        donor = max((i for i in valid if i in spread), key=lambda i: (spread[i][0] / size[i], -i), default=None)
        if donor is None or not spread[donor][0]:
            break
        centers[e] = spread[donor][2]
        moved[spread[donor][1]] = e
        valid.pop()
    return centers, moved


def kmeans(samples: DataFrame, k: int, max_iterations: int = 20, min_changes: float = 0.01, centers: np.ndarray | None = None, seed: int = 0, key: str = "key", distance: str | MatrixDistance = "l2norm_squared", init: str = "random") -> tuple[np.ndarray, DataFrame, int]:
    """(centers, assignment (key, cluster), iterations) of Lloyd's algorithm.

    distance: a name of `functions.matrix` or a function of two matrices. init: random or plusplus, if no centers are given.
    All samples begin in cluster 0. Each round assigns (ties to the first center) and stops, without moving the centers,
    if at most ceil(n * min_changes) samples changed; else the centers move to the means and empty clusters are repaired.
    max_iterations 0: no limit. Null vectors are left out; no samples give no centers.
    Nothing is kept of the samples between rounds: a round reads them once, finds each one's cluster by the former and the present centers, and sends k sums,
    counts and changes a task. A sample that a repair moved is the only one whose former cluster is not its nearest.
    """
    samples = samples.filter("vector is not null").select(key, F.col("vector").cast("array<double>").alias("vector"))
    f = matrix_distance(distance)
    if centers is None:
        if samples.isEmpty():
            return np.empty((0, 0)), samples.select(key, F.lit(0).alias("cluster")), 0
        if init not in ("random", "plusplus"):
            raise ValueError(f"unknown initialisation {init!r}; known: plusplus, random")
        first = initial_random(samples, k, seed, key) if init == "random" else initial_plusplus(samples, k, seed, key, distance=distance)
        centers = np.array([r.center for r in first.orderBy("cluster").collect()])
    centers = np.asarray(centers, np.float64)
    kind = samples.schema[key].dataType.simpleString()
    rounds, moved, former = 0, {}, None

    def nearest(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        if distance == "l2norm_squared" and len(at) * x.size >= 1 << 24:
            return ((x * x).sum(1)[:, None] - 2 * x @ at.T + (at * at).sum(1)).argmin(axis=1)
        return f(x, at).argmin(axis=1)

    while True:
        rounds += 1
        at, before, changed_owner = centers, former, moved

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, changes, sums = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.zeros_like(at)
            for b in batches:
                if b.num_rows:
                    x = np.stack(b.column(1).to_numpy(zero_copy_only=False))
                    c = nearest(x, at)
                    old = np.zeros(len(x), np.int64) if before is None else nearest(x, before)
                    if changed_owner:
                        old = np.array([changed_owner.get(v, o) for v, o in zip(b.column(0).to_pylist(), old.tolist(), strict=True)])
                    n += np.bincount(c, minlength=len(at))
                    changes += np.bincount(c, weights=c != old, minlength=len(at)).astype(np.int64)
                    np.add.at(sums, c, x)
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(changes[used]), pa.array(sums[used].tolist(), pa.list_(pa.float64()))], ["cluster", "n", "changes", "sums"])

        def merge(t: pa.Table) -> pa.Table:
            total = np.sum(np.array(t.column("sums").to_pylist()), axis=0)
            return pa.table({"cluster": t.column("cluster")[:1], "n": pa.array([int(np.sum(t.column("n").to_numpy()))]), "changes": pa.array([int(np.sum(t.column("changes").to_numpy()))]), "sums": pa.array([total.tolist()], pa.list_(pa.float64()))})

        schema = "cluster long, n long, changes long, sums array<double>"
        found = samples.mapInArrow(count, schema).groupBy("cluster").applyInArrow(merge, schema).collect()  # k rows
        changes, total = sum(r.changes for r in found), sum(r.n for r in found)
        if changes <= ceil(total * min_changes):
            break
        size = np.zeros(len(centers), np.int64)
        centers = centers.copy()
        for r in found:
            size[r.cluster] = r.n
            centers[r.cluster] = np.array(r.sums) / r.n
        former, moved = at, {}
        if (size == 0).any():
            centers, moved = _repair(_assigned(samples, at, nearest, key, kind, True), centers, size, key, f)
        if max_iterations and rounds >= max_iterations:
            break
    return centers, _assigned(samples, at, nearest, key, kind, False), rounds


def _assigned(samples: DataFrame, centers: np.ndarray, nearest: Callable[[np.ndarray, np.ndarray], np.ndarray], key: str, kind: str, vectors: bool) -> DataFrame:
    """(key, [vector,] cluster) of the samples by the nearest center."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = pa.array(nearest(np.stack(b.column(1).to_numpy(zero_copy_only=False)), centers).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0), *([b.column(1)] if vectors else []), c], [key, *(["vector"] if vectors else []), "cluster"])

    return samples.mapInArrow(run, f"`{key}` {kind}, {'vector array<double>, ' if vectors else ''}cluster int")


def compute_vocabulary(features: DataFrame, words: int, sample: int | None = None, seed: int = 0, key: str = "key", **options: float) -> DataFrame:
    """(word_id, center): a vocabulary by k-means of all features, or of a sample of that many."""
    from lumenary.operators.sampling import sample_rows

    chosen = features if sample is None else sample_rows(features, sample, [key], seed)
    centers, _, _ = kmeans(chosen, words, seed=seed, key=key, **options)
    return features.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "word_id int, center array<double>")
