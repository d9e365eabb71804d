"""Filling fixed-capacity containers: harmonic packing by reciprocal-capacity classes, independently in each worker."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default place of the public tokenizer's ranks.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenizer's pattern of that public vocabulary (a fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

_encoders: dict[str, object] = {}


def encoder(path: str) -> object:
    """The tokenizer of a rank file, built once a worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, tokens INT): the length of each whole text in tokens; a null or empty text has 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], [key, "tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(count, f"`{key}` {kind}, tokens int")


def harmonic_bins(sizes: np.ndarray, capacity: int, classes: int = 12, refill: bool = True) -> tuple[np.ndarray, int]:
    """(bin of each item, number of bins) for sizes in 1..capacity.

    Class j < classes holds sizes in (capacity/(j+1), capacity/j]; its bins get j items each, in descending order so
    that a bin's items are alike. What a full bin leaves is then offered to the smaller classes' items (largest first
    into the bin with the most room), as the refined forms of the harmonic rule do; items of the last class that remain
    are put one after another. At most one bin a class stays open. refill False: the plain rule, nothing is offered.
    """
    order = np.argsort(-sizes, kind="stable")
    cls = np.minimum(capacity // np.maximum(sizes, 1), classes)
    bins = np.full(len(sizes), -1, np.int64)
    room: list[int] = []
    import heapq

    heap: list[tuple[int, int]] = []  # (-room, bin) of the bins made so far
    for j in range(1, classes + 1):
        items = order[cls[order] == j]
        rest = []
        for i in items.tolist():
            s = int(sizes[i])
            if refill and heap and -heap[0][0] >= s:
                r, b = heapq.heappop(heap)
                bins[i] = b
                room[b] = -r - s
                if room[b]:
                    heapq.heappush(heap, (-room[b], b))
            else:
                rest.append(i)
        if j < classes:
            for at in range(0, len(rest), j):
                group = rest[at : at + j]
                b = len(room)
                room.append(capacity - int(sizes[group].sum()))
                bins[group] = b
                if room[b]:
                    heapq.heappush(heap, (-room[b], b))
        else:
            b = -1
            for i in rest:
                s = int(sizes[i])
                if b < 0 or room[b] < s:
                    b = len(room)
                    room.append(capacity)
                bins[i] = b
                room[b] -= s
    return bins, len(room)


def pack(items: DataFrame, key: str, size: str, capacity: int, per_worker: int = 20_000, rows: int | None = None, refill: bool = True) -> DataFrame:
    """(key, piece, start, tokens, container BIGINT, place): which part of an item lies where in which container.

    Sizes may be null, 0 or less: such an item is one piece of 0 tokens in container null. Only an item larger than
    `capacity` is split: into full containers and one remainder, which is packed with the other items. Items of equal
    keys are packed like any others. An empty table gives an empty result.

    `refill` False packs by the plain harmonic rule. `rows` saves counting the items (an estimate will do: it sets the number of groups). Items are dealt to groups of about
    `per_worker` by a hash that also takes in the row's place, so that equal keys spread; each group is packed by itself, so no
    task holds more, and each leaves at most one open bin a class. Other columns are ignored.
    """
    kind = items.schema[key].dataType.simpleString()
    sized = items.select(F.col(key).alias("k"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("s"))
    groups = max(1, -(-(items.count() if rows is None else rows) // per_worker))
    out = "k " + kind + ", piece int, start bigint, tokens int, container bigint, place int"

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        group = int(rows["g"].iloc[0])
        k, s = rows["k"].to_numpy(), np.maximum(rows["s"].to_numpy(), 0)
        full, rest = s // capacity, s % capacity
        pieces = full + ((rest > 0) | (s == 0))
        at = np.repeat(np.arange(len(s)), pieces)
        piece = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.where(piece < full[at], capacity, rest[at])
        some = length > 0
        bins, n = harmonic_bins(length[some], capacity, refill=refill)
        container = pd.array([pd.NA] * len(at), dtype="Int64")
        container[np.flatnonzero(some)] = bins + group * 2**32
        frame = pd.DataFrame({"k": k[at], "piece": piece.astype(np.int32), "start": piece * capacity, "tokens": length.astype(np.int32), "container": container})
        frame["place"] = frame.groupby("container", dropna=False).cumcount().astype(np.int32)
        return frame

    packed = sized.withColumn("g", F.pmod(F.xxhash64("k", "s", F.monotonically_increasing_id()), F.lit(groups))).groupBy("g").applyInPandas(one, out)
    return packed.withColumnRenamed("k", key)
