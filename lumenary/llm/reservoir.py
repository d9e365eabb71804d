"""Uniform fixed-size sample of data that arrives in pieces: a distributed reservoir over hash-partitioned slots."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenary.session import materialise, maybe_broadcast

#: Records of the reservoir that a slot holds on average; numbers from which the library's generator can't draw.
PER_SLOT, LARGE = 10_000, 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement from good + bad are good, for numbers of any size.

    Above LARGE the distribution is inverted over a window of 15 standard deviations around its mode, its weights taken from
    each one's ratio to the next; what lies outside has less probability than a double can show.
    """
    if n <= 0 or good <= 0:
        return 0
    if bad <= 0 or n >= good + bad:
        return min(n, good)
    if good < LARGE and bad < LARGE:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    spread = 15 * (isqrt(n * good // total * bad // total * (total - n) // (total - 1)) + 2)
    low, high = max(low, mode - spread), min(high, mode + spread)
    x = np.arange(mode, high, dtype=np.float64)
    up = np.cumprod((good - x) * (n - x) / ((x + 1) * (bad - n + x + 1)))
    x = np.arange(mode, low, -1, dtype=np.float64)
    down = np.cumprod(x * (bad - n + x) / ((good - x + 1) * (n - x + 1)))
    weights = np.cumsum(np.r_[down[::-1], 1.0, up])
    return low + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def _split(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """How many of n draws without replacement fall on each slot (multivariate hypergeometric, slot by slot)."""
    out, left = np.zeros(len(counts), np.int64), int(counts.sum())
    for i, c in enumerate(counts.tolist()):
        left -= c
        out[i] = hypergeometric(rng, c, left, n)
        n -= int(out[i])
    return out


def replaced(totals: list[tuple[int, int]], k: int, rng: np.random.Generator) -> list[tuple[int, int, int]]:
    """(piece, evict, insert) for pieces (piece, records) in order: of seen + n records, the reservoir's new content draws
    hypergeometric(n, seen, size) from the piece; as many of the held records as exceed k - that number leave."""
    held, seen, out = 0, 0, []
    for piece, n in totals:
        size = min(k, seen + n)
        put = hypergeometric(rng, n, seen, size)
        out.append((piece, held - (size - put), put))
        held, seen = size, seen + n
    return out


def split_steps(steps: list[tuple[int, int, int]], counts: dict[int, np.ndarray], slots: int, rng: np.random.Generator) -> list[tuple[int, int, int, int]]:
    """(piece, slot, evict, insert): the steps' numbers over the slots: inserts by the piece's counts of each slot, evictions by what the slots hold."""
    held, plan = np.zeros(slots, np.int64), []
    for piece, gone, put in steps:
        insert = _split(rng, counts.get(piece, np.zeros(slots, np.int64)), put)
        evict = _split(rng, held, gone)
        held += insert - evict
        plan += [(piece, s, int(evict[s]), int(insert[s])) for s in np.flatnonzero(evict | insert).tolist()]
    return plan


def reservoir_sample(records: DataFrame, keys: list[str], piece: str, k: int, slots: int | None = None, seed: int = 42) -> DataFrame:
    """A uniform sample of min(k, all) records, as columns `keys`; records arrive by ascending `piece`.

    `keys` name a record and must be unique. A null piece arrives first. Slots (k / PER_SLOT, at least 8) hold the reservoir: each piece sends a slot
    a uniform sample of the size drawn for it and the slot evicts uniformly; a slot's task sees its own inserts only, about
    (k / slots) * ln(all / k) rows. The draws form a tree: the driver splits each piece's number over about sqrt(slots) groups of
    slots, one task a group splits it over the group's slots.
    k <= 0 or an empty table gives an empty result. The result depends on the records and the seed, not on partitioning.
    """
    spark = records.sparkSession
    slots = slots or max(8, k // PER_SLOT)
    wide = isqrt(slots - 1) + 1  # slots of a group
    groups = -(-slots // wide)
    schema = records.select(*keys).schema
    if k <= 0:
        return spark.createDataFrame([], schema)
    named = records.select(
        *keys,
        F.coalesce(F.col(piece), F.lit(-(2**31))).cast("long").alias("_piece"),
        F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(slots)).cast("int").alias("_slot"),
        F.xxhash64(F.lit(seed + 1), *keys).alias("_priority"),
    )
    named = materialise(named)  # read by the counting and by the drawing
    counts = materialise(named.groupBy("_piece", "_slot").agg(F.count(F.lit(1)).alias("_n")))
    group = F.expr(f"_slot div {wide}").cast("int").alias("_group")
    of_group: dict[int, np.ndarray] = {}
    for r in counts.groupBy("_piece", group).agg(F.sum("_n").alias("n")).collect():  # pieces * sqrt(slots) numbers
        of_group.setdefault(r._piece, np.zeros(groups, np.int64))[r._group] = r.n
    totals = sorted((p, int(c.sum())) for p, c in of_group.items())
    rng = np.random.default_rng(seed)
    steps = split_steps(replaced(totals, k, rng), of_group, groups, rng)
    if not steps:
        return spark.createDataFrame([], schema)
    given = spark.createDataFrame(steps, "_piece long, _group int, _evict long, _insert long")

    def over_slots(key: tuple, steps: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        first = int(key[0]) * wide
        n = min(wide, slots - first)
        held: dict[int, np.ndarray] = {}
        for p, s, c in zip(own["_piece"].tolist(), own["_slot"].tolist(), own["_n"].tolist(), strict=True):
            held.setdefault(p, np.zeros(n, np.int64))[s - first] = c
        order = sorted(zip(steps["_piece"].tolist(), steps["_evict"].tolist(), steps["_insert"].tolist(), strict=True))
        rows = split_steps(order, held, n, np.random.default_rng([seed, 7, first]))
        return pd.DataFrame([(p, s + first, e, i) for p, s, e, i in rows], columns=["_piece", "_slot", "_evict", "_insert"])

    by_group = counts.withColumn("_group", group).groupBy("_group")
    plan = materialise(given.groupBy("_group").cogroup(by_group).applyInPandas(over_slots, "_piece long, _slot int, _evict long, _insert long"))
    top = Window.partitionBy("_piece", "_slot").orderBy("_priority", *keys)
    drawn = (
        named.join(maybe_broadcast(plan.filter("_insert > 0").select("_piece", "_slot", "_insert")), ["_piece", "_slot"])
        .withColumn("_r", F.row_number().over(top))
        .filter((F.col("_r") <= k) & (F.col("_r") <= F.col("_insert")))
    )

    def replay(key: tuple, rows: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
        slot = int(key[0])
        rng = np.random.default_rng([seed, slot])
        rows = rows.sort_values(["_piece", "_r"], kind="stable").reset_index(drop=True)
        start = {p: (g.index[0], g.index[-1] + 1) for p, g in rows.groupby("_piece")}
        held = np.empty(0, np.int64)
        for p, evict, insert in sorted(zip(steps["_piece"].tolist(), steps["_evict"].tolist(), steps["_insert"].tolist(), strict=True)):
            if evict:
                held = np.delete(held, rng.choice(len(held), evict, replace=False))
            if insert:
                held = np.r_[held, np.arange(*start[p])]
        return rows.loc[held, keys]

    return drawn.select(*keys, "_piece", "_slot", "_r").groupBy("_slot").cogroup(plan.groupBy("_slot")).applyInPandas(replay, schema)


def usable_local_features(df: DataFrame, dim: int = 64) -> DataFrame:
    """(image_id, n, piece) of the usable local features of the newest row of each image: every feature once."""
    import pyarrow as pa

    from lumenary.features import FEATURES_PER_IMAGE, keyed
    from lumenary.operators.latest import latest_rows

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, _ = keyed(b, dim)
            image = key // FEATURES_PER_IMAGE
            ids = np.asarray(b.column("image_id"))
            order = np.argsort(ids, kind="stable")
            row = order[np.searchsorted(ids[order], image)]
            yield pa.RecordBatch.from_arrays([pa.array(image), pa.array((key % FEATURES_PER_IMAGE).astype(np.int32)), b.column("piece").take(pa.array(row))], ["image_id", "n", "piece"])

    return latest_rows(df, "image_id", "computed_at", ["features", "piece"]).mapInArrow(take, "image_id bigint, n int, piece int")
