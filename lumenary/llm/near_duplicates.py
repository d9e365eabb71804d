"""Near-duplicate vectors: MinHash candidates, Bayesian pruning, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.session import materialise, maybe_broadcast
from lumenary.vectors import fixed_binary, from_binary, unit

#: Hashes a band; how often a pair at the stated set similarity may share no band; hashes compared by the pruning, how many at a time, and how often a
#: pair that reaches that similarity may be lost to it.
ROWS, UNSEEN, COMPARED, STEP, TOLERANCE = 14, 2e-3, 256, 32, 1e-4
#: Members from which a bucket is split; keys looked at for that (one in so many); pairs of a block that are verified together.
HOT, LOOKED_AT, VERIFIED = 2000, 64, 8192


class MinHasher:
    """MinHash of the set of places at which a vector lies above its own mean.

    Such sets keep their Jaccard similarity when a vector is scaled, and small edits to the vector move few places in or
    out. A hash is the first place, in a random order of all places, that is in the set.
    """

    def __init__(self, dim: int, hashes: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.orders = np.stack([rng.permutation(dim) for _ in range(hashes)]).astype(np.int16)

    def __call__(self, m: np.ndarray, depth: int = 24) -> np.ndarray:
        inside = m > m.mean(axis=1, dtype=np.float64, keepdims=True)
        out = np.empty((len(m), len(self.orders)), np.int16)
        for h, order in enumerate(self.orders):
            part = inside[:, order[:depth]]
            first = part.argmax(axis=1)
            none = np.flatnonzero(~part[np.arange(len(m)), first])
            out[:, h] = order[first]
            if len(none):
                whole = inside[np.ix_(none, order)]
                first = whole.argmax(axis=1)
                out[none, h] = np.where(whole.any(axis=1), order[first], -1)
        return out


def least_matches(jaccard: float, tolerance: float, compared: int = COMPARED, step: int = STEP) -> list[tuple[int, int]]:
    """(hashes compared, least matches to go on): below, the posterior probability of `jaccard` or more is < tolerance.

    With a uniform prior the posterior after m matches of n is Beta(m + 1, n - m + 1), whose mass above t is the
    probability of at most m successes in n + 1 trials of probability t. Hashes are compared by 4 bits, which adds
    one chance match in 16 of the rest.
    """
    t = jaccard + (1 - jaccard) / 16
    out = []
    for n in range(step, compared + 1, step):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += exp(lgamma(n + 2) - lgamma(m + 1) - lgamma(n + 2 - m) + m * log(t) + (n + 1 - m) * log(1 - t))
        out.append((n, m))
    return out


def band_count(jaccard: float, unseen: float = UNSEEN, rows: int = ROWS) -> int:
    """Bands of `rows` hashes so that a pair of that set similarity shares none with a probability of at most `unseen`."""
    return max(1, ceil(log(unseen) / log(1 - jaccard**rows)))


def pairs_within(rows: DataFrame, group: str, key: str) -> DataFrame:
    """(a, b), a < b, in no order and perhaps repeatedly: the pairs of keys in one group.

    Groups of more than about HOT members (found in one key of LOOKED_AT) are met in parts: a key is on the left in one part, by a
    hash, and on the right in all, so no task holds a large group twice and every pair is met once.
    """
    rows = rows.select(F.col(group).alias("g"), F.col(key).alias("k"))
    seen = rows.filter(F.pmod(F.xxhash64("k", F.lit(23)), F.lit(LOOKED_AT)) == 0).groupBy("g").count()
    hot = materialise(seen.filter(F.col("count") * LOOKED_AT > HOT / 2).select("g", F.ceil(F.col("count") * LOOKED_AT / HOT).alias("parts")))
    left, right = rows.select("g", F.col("k").alias("a")), rows.select("g", F.col("k").alias("b"))
    if hot.isEmpty():
        return left.join(right, "g").filter("a < b").select("a", "b")
    few = maybe_broadcast(hot)
    n = F.coalesce("parts", F.lit(1))
    left = left.join(few, "g", "left").select("g", "a", F.pmod(F.xxhash64("a", F.lit(29)), n).alias("part"))
    right = right.join(few, "g", "left").select("g", "b", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("part"))
    return left.join(right, ["g", "part"]).filter("a < b").select("a", "b")


def signatures(vectors: DataFrame, dim: int, bands: int) -> DataFrame:
    """(key, buckets ARRAY<BIGINT>, signature BINARY): a bucket for each band, and COMPARED further hashes by 4 bits."""
    hashes = ROWS * bands + COMPARED

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHasher(dim, hashes)
        weights = np.random.default_rng(11).integers(1, 2**63, (bands, ROWS), dtype=np.uint64) | np.uint64(1)
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                h = hasher(from_binary(part.column("raw"), "<f4", dim))
                banded = h[:, : ROWS * bands].reshape(-1, bands, ROWS).astype(np.uint64)
                mixed = (banded * weights).sum(axis=2, dtype=np.uint64)
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.arange(bands, dtype=np.uint64)
                low = (h[:, ROWS * bands :] & 15).astype(np.uint8)
                packed = low[:, ::2] | (low[:, 1::2] << 4)
                buckets = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * bands), pa.array(mixed.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part.column("key"), buckets, fixed_binary(packed)], ["key", "buckets", "signature"])

    return vectors.mapInArrow(sign, "key long, buckets array<long>, signature binary")


def placed_pairs(pairs: DataFrame) -> DataFrame:
    """(block, a, b): distinct pairs dealt to blocks of about VERIFIED so that pairs of one neighbourhood (named by the least partner of a) mostly lie
    in one block; a neighbourhood of more is dealt by a."""
    blocks = max(1, pairs.count() // VERIFIED)
    least = pairs.select(F.col("b").alias("a"), F.col("a").alias("l")).groupBy("a").agg(F.min("l").alias("l"))
    near = pairs.join(least, "a", "left").select("a", "b", F.coalesce("l", "a").alias("l"))
    near = materialise(near)
    large = near.groupBy("l").count().filter(F.col("count") > VERIFIED).select("l", F.ceil(F.col("count") / VERIFIED).alias("parts"))
    dealt = near.join(maybe_broadcast(large), "l", "left").withColumn("part", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))))
    return dealt.select(F.pmod(F.xxhash64("l", "part"), F.lit(blocks)).alias("block"), "a", "b")


_codec = pa.Codec("zstd", 1)


def _small(m: np.ndarray) -> list[bytes]:
    """Each row of a float32 matrix byte plane by byte plane, compressed without loss."""
    planes = np.ascontiguousarray(m, "<f4").view(np.uint8).reshape(len(m), -1, 4).transpose(0, 2, 1)
    return [_codec.compress(r.tobytes(), asbytes=True) for r in planes]


def _grown(blobs: list[bytes], dim: int) -> np.ndarray:
    planes = np.frombuffer(b"".join(_codec.decompress(d, dim * 4, asbytes=True) for d in blobs), np.uint8).reshape(-1, 4, dim)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<f4").reshape(-1, dim)


def pruned_and_verified(pairs: DataFrame, signed: DataFrame, vectors: DataFrame, dim: int, jaccard: float, least: float, tolerance: float = TOLERANCE) -> DataFrame:
    """(a, b, similarity): the pairs that survive the Bayesian pruning and whose cosine in double precision, rounded to 9 decimals, is at least `least`.

    A vector and its signature go once to each block of pairs that needs them, not once a pair.
    """
    placed = materialise(placed_pairs(pairs))
    needed = materialise(placed.select("block", F.explode(F.array("a", "b")).alias("key")).distinct())
    limits = least_matches(jaccard, tolerance)

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = from_binary(b.column("raw"), "<f4", dim)
            for i in range(0, len(m), 2048):
                yield pa.RecordBatch.from_arrays([b.column("key")[i : i + 2048], pa.array(_small(m[i : i + 2048]), pa.binary())], ["key", "data"])

    where = maybe_broadcast(needed)
    about = signed.select("key", F.col("signature").alias("data")).join(where, "key").select("block", "key", F.lit(0).alias("kind"), "data")
    sent = vectors.mapInArrow(shrink, "key long, data binary").join(where, "key").select("block", "key", F.lit(1).alias("kind"), "data")

    def check(pairs: pa.Table, rows: pa.Table) -> pa.Table:
        kind, keys = rows.column("kind").to_numpy(), rows.column("key").to_numpy()
        data = np.array(rows.column("data").to_pylist(), dtype=object)
        order = [np.flatnonzero(kind == x) for x in (0, 1)]
        order = [o[np.argsort(keys[o])] for o in order]
        a, b = pairs.column("a").to_numpy(), pairs.column("b").to_numpy()
        signature = np.frombuffer(b"".join(data[order[0]]), np.uint8).reshape(-1, COMPARED // 2)
        x = signature[np.searchsorted(keys[order[0]], a)] ^ signature[np.searchsorted(keys[order[0]], b)] if len(a) else signature[:0]
        alive, matches, done = np.arange(len(x)), np.zeros(len(x), np.int64), 0
        for n, most in limits:
            part = x[alive, done // 2 : n // 2]
            matches = matches + ((part & 15) == 0).sum(axis=1) + ((part >> 4) == 0).sum(axis=1)
            on = matches >= most
            alive, matches, done = alive[on], matches[on], n
        a, b = a[alive], b[alive]
        used, place = np.unique(np.r_[a, b], return_inverse=True)
        raw = _grown(data[order[1][np.searchsorted(keys[order[1]], used)]] if len(used) else [], dim)
        s = np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", unit(raw[place[i : min(i + 2048, len(a))]]), unit(raw[place[len(a) + i : len(a) + min(i + 2048, len(a))]])) for i in range(0, len(a), 2048))]).round(9)
        on = s >= least
        return pa.table({"a": a[on], "b": b[on], "similarity": s[on]})

    return placed.groupBy("block").cogroup(about.unionByName(sent).groupBy("block")).applyInArrow(check, "a long, b long, similarity double")


def similar_classes(vectors: DataFrame, dim: int, least: float, jaccard: float) -> tuple[DataFrame, DataFrame]:
    """(links, members): links (a, b, similarity) between representatives; members (key, rep).

    vectors: key, raw (as of lumenary.features). Vectors of equal bytes are one class, represented by its smallest
    key, so a group of copies costs one vector. `least` is the cosine that a link needs; `jaccard` is the set
    similarity below which no such pair is expected (for GIST-like vectors and 0.97: 0.86). At that similarity a pair is lost
    with a probability of UNSEEN (no common band) and TOLERANCE (pruned), above it with less. Without vectors there are no links.
    """
    a, b = F.xxhash64("raw"), F.hash("raw")
    members = vectors.select("key", a.alias("h1"), b.alias("h2"))
    reps = members.groupBy("h1", "h2").agg(F.min("key").alias("rep"))
    members = materialise(members.join(reps, ["h1", "h2"]).select("key", "rep"))
    copies = maybe_broadcast(members.filter("key <> rep").select("key"))
    distinct = vectors.join(copies, "key", "left_anti")
    signed = materialise(signatures(distinct, dim, band_count(jaccard)))
    pairs = materialise(pairs_within(signed.select("key", F.explode("buckets").alias("bucket")), "bucket", "key").distinct())
    return pruned_and_verified(pairs, signed, distinct, dim, jaccard, least), members


def all_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b), a < b: every pair of members of linked classes, and of one class."""
    ma, mb = members.select(F.col("key").alias("ka"), F.col("rep").alias("a")), members.select(F.col("key").alias("kb"), F.col("rep").alias("b"))
    across = links.join(ma, "a").join(mb, "b").select("ka", "kb")
    several = members.filter("key <> rep").select("rep").distinct()
    inside = pairs_within(members.join(maybe_broadcast(several), "rep", "left_semi"), "rep", "key").toDF("ka", "kb")
    both = across.unionByName(inside)
    return both.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))
