"""Property files as a Spark data source: one homogeneous vector of values with positions.

Layout (fixed by the format): the elements' bytes, a vector of their int64 offsets, a map of strings (`__version` 2,
`__typeinfo`, `__features`, `__offsets`), and the map's position as int64 at the very end. Numbers are little-endian; a
string has an int32 length, vectors, maps and sets an int64 length.
"""

from __future__ import annotations

import io
import os
import shutil
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Type names of the format, their NumPy codes and the Spark types that hold them.
NUMBERS = {
    "int8_t": ("i1", "tinyint"),
    "int16_t": ("i2", "smallint"),
    "int32_t": ("i4", "int"),
    "int64_t": ("i8", "bigint"),
    "u_int8_t": ("u1", "smallint"),
    "u_int16_t": ("u2", "int"),
    "u_int32_t": ("u4", "bigint"),
    "u_int64_t": ("u8", "decimal(20,0)"),
    "float": ("f4", "float"),
    "double": ("f8", "double"),
}
STRING = "std::string"
#: Elements a partition reads.
PART = 50_000


def parse(name: str) -> tuple[str, list]:
    """(kind, parameters) of a type name, e.g. ("vector", [("float", [])]); an unknown one is an error."""
    name = name.strip()
    if name == STRING or name in NUMBERS:
        return name, []
    for kind, arity in (("vector", 1), ("set", 1), ("pair", 2), ("map", 2)):
        if name.startswith(f"std::{kind}<") and name.endswith(">"):
            inside, depth, parts = name[len(kind) + 6 : -1], 0, [""]
            for c in inside:
                depth += (c == "<") - (c == ">")
                if c == "," and not depth:
                    parts.append("")
                else:
                    parts[-1] += c
            if len(parts) == arity:
                return kind, [parse(p) for p in parts]
    raise ValueError(f"unknown type {name!r} in a property file")


def spark_type(kind: tuple[str, list]) -> str:
    name, parts = kind
    inner = [spark_type(p) for p in parts]
    simple = {"vector": "array<{}>", "set": "array<{}>", "map": "map<{},{}>", "pair": "struct<first:{},second:{}>"}
    if name in simple:
        return simple[name].format(*inner)
    return "string" if name == STRING else NUMBERS[name][1]


def _number(f: io.BufferedIOBase, code: str) -> int:
    return struct.unpack(code, f.read(struct.calcsize(code)))[0]


def read_value(f: io.BufferedIOBase, kind: tuple[str, list]) -> object:
    name, parts = kind
    if name in NUMBERS:
        value = np.frombuffer(f.read(np.dtype("<" + NUMBERS[name][0]).itemsize), "<" + NUMBERS[name][0])[0].item()
        return Decimal(value) if name == "u_int64_t" else value
    if name == STRING:
        return f.read(_number(f, "<i")).decode("utf-8", "replace")
    if name == "pair":
        return tuple(read_value(f, p) for p in parts)
    n = _number(f, "<q")
    if name == "map":
        return {read_value(f, parts[0]): read_value(f, parts[1]) for _ in range(n)}
    if parts[0][0] in NUMBERS and parts[0][0] != "u_int64_t":
        code = np.dtype("<" + NUMBERS[parts[0][0]][0])
        return np.frombuffer(f.read(n * code.itemsize), code).tolist()
    return [read_value(f, parts[0]) for _ in range(n)]


def write_value(f: io.BufferedIOBase, kind: tuple[str, list], value: object) -> None:
    name, parts = kind
    if name in NUMBERS:
        f.write(np.asarray(int(value) if name == "u_int64_t" else value, "<" + NUMBERS[name][0]).tobytes())
    elif name == STRING:
        data = str(value).encode()
        f.write(struct.pack("<i", len(data)) + data)
    elif name == "pair":
        for p, v in zip(parts, value, strict=True):
            write_value(f, p, v)
    elif name == "map":
        f.write(struct.pack("<q", len(value)))
        for k in sorted(value):
            write_value(f, parts[0], k)
            write_value(f, parts[1], value[k])
    else:
        values = sorted(set(value)) if name == "set" else value
        f.write(struct.pack("<q", len(values)))
        if parts[0][0] in NUMBERS and parts[0][0] != "u_int64_t":
            f.write(np.asarray(values, "<" + NUMBERS[parts[0][0]][0]).tobytes())
        else:
            for v in values:
                write_value(f, parts[0], v)


def _tail(path: str, given: str | None = None) -> tuple[tuple[str, list], int, int]:
    """(type, place of the first offset, number of offsets) from the end of a file. Version 1 files have no type name: it must be given; a given name must match that of a version 2 file."""
    with open(path, "rb") as f:
        f.seek(-8, io.SEEK_END)
        f.seek(_number(f, "<q"))
        meta = read_value(f, parse("std::map<std::string,std::string>"))
        version = meta.get("__version")
        if version not in ("1", "2"):
            raise ValueError(f"{path}: version {version!r} of a property file is not known")
        name = meta.get("__typeinfo") if version == "2" else given
        if not name or given not in (None, name):
            raise ValueError(f"{path} holds elements of type {name!r}; asked for {given!r}")
        at = int(meta["__offsets"])
        f.seek(at)
        return parse(name), at + 8, _number(f, "<q")


class _Part(InputPartition):
    def __init__(self, start: int, count: int) -> None:
        self.start, self.count = start, count


class _Reader(DataSourceReader):
    def __init__(self, path: str, given: str | None) -> None:
        self.path, self.given = path, given

    def partitions(self) -> list[_Part]:
        n = _tail(self.path, self.given)[2]
        return [_Part(i, min(PART, n - i)) for i in range(0, n, PART)] or [_Part(0, 0)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        """The rows of a range of positions; of the offsets only the range's own are read."""
        kind, first, _ = _tail(self.path, self.given)
        with open(self.path, "rb") as f:
            f.seek(first + 8 * partition.start)
            offsets = np.frombuffer(f.read(8 * partition.count), "<i8").tolist()
            for i, at in enumerate(offsets):
                if at >= 0:  # positions that were never written have no row
                    f.seek(at)
                    yield partition.start + i, read_value(f, kind)


@dataclass
class _Written(WriterCommitMessage):
    path: str
    idx: np.ndarray
    offsets: np.ndarray


class _Writer(DataSourceWriter):
    """Each task writes its elements to a file of its own beside the path; the commit appends these files and adds the offsets."""

    def __init__(self, path: str, name: str) -> None:
        parse(name)
        self.path, self.name = path, name

    def write(self, rows: Iterator) -> _Written:
        part, kind = f"{self.path}.{uuid.uuid4().hex}.part", parse(self.name)
        idx, offsets = [], []
        with open(part, "wb") as f:
            for r in rows:
                idx.append(r["idx"])
                offsets.append(f.tell())
                write_value(f, kind, r["value"])
        return _Written(part, np.array(idx, np.int64), np.array(offsets, np.int64))

    def commit(self, messages: list) -> None:
        done = [m for m in messages if m is not None]
        try:
            every = np.concatenate([np.empty(0, np.int64), *(m.idx for m in done)])
            if len(np.unique(every)) < len(every):
                raise ValueError("a position is written twice")
            offsets = np.full(int(every.max()) + 1 if len(every) else 0, -1, np.int64)
            with open(f"{self.path}.whole", "wb") as f:
                for m in done:
                    offsets[m.idx] = m.offsets + f.tell()
                    with open(m.path, "rb") as g:
                        shutil.copyfileobj(g, f, 1 << 22)
                _finish(f, offsets, self.name)
            os.replace(f"{self.path}.whole", self.path)
        finally:
            self.abort(done)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class PropertyFile(DataSource):
    """spark.read.format("propfile").load(path) -> (idx BIGINT, value); rows (idx, value) are written by format("propfile").option("type", ...).save(path).

    Register with spark.dataSource.register(PropertyFile).

    The path is a local or mounted file that all executors see; elements are read by offset ranges in parallel. The option
    `type` names the elements' type: needed for version 1 files, checked against version 2 files.
    """

    @classmethod
    def name(cls) -> str:
        return "propfile"

    def schema(self) -> str:
        return f"idx bigint, value {spark_type(_tail(self.options['path'], self.options.get('type'))[0])}"

    def reader(self, schema: object) -> _Reader:
        return _Reader(self.options["path"], self.options.get("type"))

    def writer(self, schema: object, overwrite: bool) -> _Writer:
        """Needs the option `type`; positions come in any order, once each, and gaps are kept. Appending is not possible."""
        if "type" not in self.options:
            raise ValueError("the option `type` must name the elements' type")
        if not overwrite and os.path.exists(self.options["path"]):
            raise ValueError("a property file can't be appended to")
        return _Writer(self.options["path"], self.options["type"])


def _finish(f: io.BufferedIOBase, offsets: np.ndarray, name: str) -> None:
    """The offsets, the map of strings and its position, at the end of the elements."""
    at, text = f.tell(), parse(STRING)
    f.write(struct.pack("<q", len(offsets)) + np.asarray(offsets, "<i8").tobytes())
    end = f.tell()
    write_value(f, ("map", [text, text]), {"__features": "0", "__offsets": str(at), "__typeinfo": name, "__version": "2"})
    f.write(struct.pack("<q", end))


def write_property_file(rows: Iterator[tuple[int, object]], path: str, name: str) -> int:
    """Write (idx, value) rows, ascending by idx, one after another; gaps get offset -1. Returns the number of positions.

    For a DataFrame: write_property_file(df.orderBy("idx").toLocalIterator(), path, "std::vector<float>").
    """
    kind = parse(name)
    offsets: list[int] = []
    with open(path, "wb") as f:
        for idx, value in rows:
            if idx < len(offsets):
                raise ValueError("rows must come by ascending, different idx")
            offsets += [-1] * (idx - len(offsets)) + [f.tell()]
            write_value(f, kind, value)
        _finish(f, np.array(offsets, np.int64), name)
    return len(offsets)
