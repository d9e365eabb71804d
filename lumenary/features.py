"""Usable vectors of the descriptor tables as (key, raw vector) rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumenary.operators.latest import latest_rows
from lumenary.vectors import fixed_binary, usable_rows

#: A feature key is image_id * FEATURES_PER_IMAGE + place.
FEATURES_PER_IMAGE = 1000


def global_features(df: DataFrame, dim: int = 768) -> DataFrame:
    """(key BIGINT, raw BINARY of `dim` float32) of the usable vectors of the newest row of each image_id."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, m = usable_rows(b.column("features"), dim)
            if len(at):
                yield pa.RecordBatch.from_arrays([b.column("image_id").take(pa.array(at)), fixed_binary(m)], ["key", "raw"])

    return latest_rows(df, "image_id", "computed_at", ["features"]).mapInArrow(take, "key long, raw binary")


def local_features(df: DataFrame, dim: int = 64) -> DataFrame:
    """(key BIGINT, raw BINARY) of the usable local features of the newest row of each image_id.

    key = image_id * 1000 + place; places from 1,000 on would meet the next image's keys and raise an error.
    """

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, m = keyed(b, dim)
            for i in range(0, len(key), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[i : i + 20_000]), fixed_binary(m[i : i + 20_000])], ["key", "raw"])

    return latest_rows(df, "image_id", "computed_at", ["features"]).mapInArrow(take, "key long, raw binary")


def keyed(b: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature keys and matrix of the usable features of a batch with image_id and features."""
    lists = b.column("features")
    offsets = np.asarray(lists.offsets)
    lengths = np.diff(offsets)
    if lists.null_count:
        lengths = np.where(np.asarray(lists.is_valid()), lengths, 0)
    row = np.repeat(np.arange(len(lists)), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    if len(place) and place.max() >= FEATURES_PER_IMAGE:
        raise ValueError(f"an image has more than {FEATURES_PER_IMAGE} features; their keys would clash")
    inner = lists.flatten()
    at, m = usable_rows(inner, dim)
    ids = np.asarray(b.column("image_id"))
    return ids[row[at]] * FEATURES_PER_IMAGE + place[at], m
