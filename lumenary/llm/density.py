"""Clusters of similar vectors: hierarchical density clustering on a mutual-reachability neighbour graph.

Steps: (1) cells of similar vectors (additive-quantisation prefixes, crowded ones refined by further words; every vector
in several) give each vector's neighbours; within a cell the minimum spanning tree of the mutual reachability distances is
built, its edges up to `epsilon` are contracted, and the longer ones up to `reach` kept. (2) What lies in no piece of FEW
members and not within `epsilon` of the mean of one is searched once more in cells fitted to its like, where small groups that the first cells parted meet.
(3) Distributed Borůvka rounds join pieces of under `min_size` members along their lightest edges, at any density, to the
leaves of the condensed hierarchy. (4) The hierarchy of the leaves is built in Borůvka rounds and cut where the stability is
greatest. (5) The vectors of small pieces belong to the cluster whose mean is nearest, if that is within `epsilon`. (6) The
members that persist longest (smallest core distance) are a cluster's exemplars.

A piece that holds together up to `epsilon` is not split further (the selection-epsilon rule), so groups of near copies
inside a cluster don't become clusters of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenary.features import keyed
from lumenary.llm.additive import Cells
from lumenary.llm.components import _compose, boruvka, choices, components, relabel, turned
from lumenary.llm.neighbours import fit_cells, fit_rows
from lumenary.operators.latest import latest_rows
from lumenary.session import forget, materialise, maybe_broadcast
from lumenary.vectors import fixed_binary, from_binary, unit

#: Members from which a piece is not searched again; rows of a cell above which it is refined, and above which (where no word is left) it is dealt to
#: blocks by a hash; rows of a tree at most; leaves' edges up to which one task builds their hierarchy; means up to which all go to every worker.
FEW, REFINE, DEALT, TREE, ONE_TASK, MEANS = 64, 2048, 4096, 6144, 200_000, 20_000


def _kth_largest(s: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row of s (from 0); few by repeated maxima, which put back what they took."""
    if k > 16:
        return np.partition(s, s.shape[1] - 1 - k, axis=1)[:, s.shape[1] - 1 - k]
    rows, taken = np.arange(len(s)), []
    for _ in range(k):
        at = s.argmax(axis=1)
        taken.append((at, s[rows, at]))
        s[rows, at] = -np.inf
    largest = s.max(axis=1)
    for at, value in taken:
        s[rows, at] = value
    return largest


def _pieces(close: np.ndarray) -> np.ndarray:
    """Each row's connected component of the symmetric relation `close`, named by its smallest row."""
    piece = np.arange(len(close))
    new = close.sum(axis=1) > 1  # the others are alone
    for i in np.flatnonzero(new):
        if not new[i]:
            continue
        new[i] = False
        held = close[i]
        edge = np.flatnonzero(held & new)
        while len(edge):
            new[edge] = False
            held = held | close[edge].any(axis=0)
            edge = np.flatnonzero(held & new)
        piece[held] = i
    return piece


def local_tree(x: np.ndarray, min_samples: int, epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(core distances, pieces, a, b, w) of unit rows: each row's piece (its smallest row) when all mutual reachability distances 1 - cosine up to
    epsilon are contracted, and the edges (between rows of different pieces) of the minimum spanning tree of the pieces (Prim)."""
    n = len(x)
    d = x @ x.T
    k = min(min_samples - 1, n - 1)
    core = np.maximum(1 - _kth_largest(d, k), 0) if n >= min_samples else np.full(n, 2, d.dtype)
    np.subtract(1, d, out=d)
    np.maximum(d, core, out=d)
    np.maximum(d, core[:, None], out=d)
    close = d <= epsilon
    np.fill_diagonal(close, True)
    piece = _pieces(close)
    order = np.argsort(piece, kind="stable")
    heads, starts = np.unique(piece[order], return_index=True)
    m = len(heads)
    if m == 1:
        none = np.empty(0, np.int64)
        return core, piece, none, none, np.empty(0)
    if m < n:
        several = [(i, order[j:k]) for i, j, k in zip(range(m), starts.tolist(), [*starts[1:].tolist(), n], strict=True) if k - j > 1]
        rows = d[heads]
        for i, own in several:
            rows[i] = d[own].min(axis=0)
        d = rows[:, heads]
        for i, own in several:
            d[:, i] = rows[:, own].min(axis=1)
    best, via, out = d[0].copy(), np.zeros(m, np.int64), np.ones(m, bool)
    out[0] = False
    best[0] = np.inf
    a, b, w, nearer = np.empty(m - 1, np.int64), np.empty(m - 1, np.int64), np.empty(m - 1), np.empty(m, bool)
    for i in range(m - 1):
        j = int(best.argmin())
        a[i], b[i], w[i] = via[j], j, best[j]
        best[j], out[j] = np.inf, False
        np.less(d[j], best, out=nearer)
        np.logical_and(nearer, out, out=nearer)
        at = nearer.nonzero()[0]
        best[at] = d[j][at]
        via[at] = j
    return core, piece, heads[a], heads[b], w


def _eighth(x: np.ndarray) -> np.ndarray:
    """Unit rows in 8 bits a component."""
    return np.rint(x * (127 / np.abs(x).max(axis=1, keepdims=True))).astype(np.int8)


def _float(small: np.ndarray) -> np.ndarray:
    x = small.astype(np.float32)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    return x


_CELL = "cell long, keys binary, small binary, first binary"
#: Components of the vectors that are put into rows of _CELL at once.
PACKED = 1 << 23


def _placed(cells: Cells, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, whether it is the row's first): each vector's cells; what no word splits is dealt to blocks by a hash that differs from cell to cell of a vector."""
    who, cell, _ = cells.place(x, False)
    order = np.argsort(who, kind="stable")
    who, cell = who[order], cell[order]
    first = np.r_[True, who[1:] != who[:-1]] if len(who) else np.zeros(0, bool)
    turn = np.arange(len(who)) - np.maximum.accumulate(np.where(first, np.arange(len(who)), 0))
    with np.errstate(over="ignore"):
        mixed = (ids[who].view(np.uint64) ^ (turn.astype(np.uint64) << np.uint64(56))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
    return who, cell << 20 | mixed.astype(np.int64) % cells.blocks(cell), first


def _joined(m: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The rows from each of `starts` to the next as one binary."""
    m = np.ascontiguousarray(m)
    width = m.itemsize * (m.shape[1] if m.ndim > 1 else 1)
    offsets = (np.r_[starts, len(m)] * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(m.tobytes())])


def _packed(cells: Cells, parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], dim: int, field: int) -> Iterator[pa.RecordBatch]:
    """Rows of _CELL of parts (keys, unit rows, the same in 8 bits): the vectors of about PACKED components that are in one cell share a row."""
    most = max(1, PACKED // dim)

    def pack() -> pa.RecordBatch:
        keys, small, cell, first = (np.concatenate(p) for p in zip(*held, strict=True))
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        return pa.RecordBatch.from_arrays([pa.array(cell[starts] * 2 + field), _joined(keys[order], starts), _joined(small[order], starts), _joined(first[order], starts)], ["cell", "keys", "small", "first"])

    held, n = [], 0
    for keys, x, small in parts:
        who, cell, first = _placed(cells, keys, x)
        held.append((keys[who], small[who], cell, first))
        n += len(who)
        if n >= most:
            yield pack()
            held, n = [], 0
    if n:
        yield pack()


def _groups(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(cell, keys, small, first) of each cell of rows _CELL in the order of their cells; one cell is held at a time."""
    held, at = [], None
    for b in batches:
        cell = np.asarray(b.column("cell"))
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.empty(0, np.int64)
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(cell)], strict=False):
            if at is not None and cell[i] != at:
                yield at, *(np.concatenate(p) for p in zip(*held, strict=True))
                held = []
            at = int(cell[i])
            run = b.slice(i, j - i)
            held.append((_bytes(run.column("keys")).view(np.int64), _bytes(run.column("small")).view(np.int8).reshape(-1, dim), _bytes(run.column("first")).view(bool)))
    if at is not None:
        yield at, *(np.concatenate(p) for p in zip(*held, strict=True))


def _bytes(col: pa.Array) -> np.ndarray:
    """The bytes of a binary column one after the other."""
    offsets = np.frombuffer(col.buffers()[1], np.int32 if pa.types.is_binary(col.type) else np.int64)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]


_TREE = "kind byte, x long, y long, w double, total binary"


def _trees(rows: DataFrame, dim: int, min_samples: int, epsilon: float, reach: float, first_search: bool) -> DataFrame:
    """(kind, x, y, w, total) of rows _CELL: kind 0: vector x lies in piece y with core distance w; kind 1: pieces x and y are w apart;
    kind 2 (first search only): the vectors whose first cell this is in piece x of two or more add up to total. The first search
    leaves edges between two pieces of fewer than `min_samples` to the second, in which both are; total of kind 0 is a vector that may be searched again
    (its piece in its first cell has under FEW), else null."""

    def out(kind: int, x: np.ndarray, y: np.ndarray, w: np.ndarray, total: pa.Array | None = None) -> pa.RecordBatch:
        total = pa.nulls(len(x), pa.binary()) if total is None else total
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int8)), pa.array(x), pa.array(y), pa.array(w.astype(np.float64)), total], ["kind", "x", "y", "w", "total"])

    def one(keys: np.ndarray, small: np.ndarray, first: np.ndarray, cell: int) -> Iterator[pa.RecordBatch]:
        core, local, a, b, w = local_tree(_float(small), min_samples, epsilon)
        # a piece is named by one of its vectors in this cell
        piece = _name(keys[local], cell)
        far = w <= reach
        if not first_search:
            yield out(0, keys, piece, core)
        else:
            count = np.bincount(local, minlength=len(keys))[local]
            far &= np.maximum(count[a], count[b]) >= min_samples
            again = first & (count < FEW)
            yield out(0, keys[~again], piece[~again], core[~again])
            if again.any():
                yield out(0, keys[again], piece[again], core[again], fixed_binary(small[again]))
            summed = first & (count > 1)
            if summed.any():
                which, place = np.unique(piece[summed], return_inverse=True)
                added = np.zeros((len(which), dim), np.float32)
                np.add.at(added, place, _float(small[summed]))
                yield out(2, which, which, np.zeros(len(which)), fixed_binary(added))
        if far.any():
            yield out(1, piece[a[far]], piece[b[far]], w[far])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for cell, keys, small, first in _groups(batches, dim):
            order = np.argsort(keys, kind="stable")
            keys, small, first = keys[order], small[order], first[order]
            parts = -(-len(keys) // TREE)
            with np.errstate(over="ignore"):
                part = (keys.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)).astype(np.int64) % parts
            for p in range(parts):
                own = np.flatnonzero(part == p)
                if len(own):
                    held += one(keys[own], small[own], first[own], cell)
            n += len(keys)
            if n >= 1 << 15:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(search, _TREE)


def _name(keys: np.ndarray, cell: int) -> np.ndarray:
    """A 63-bit name of the piece that key heads in the cell; its last bit is the key's, the field."""
    with np.errstate(over="ignore"):
        h = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(cell * 0xC2B2AE3D27D4EB4F % 2**64)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(29))) >> np.uint64(1)).astype(np.int64) & ~1 | keys & 1


def _first_search(df: DataFrame, dim: int, field: int, min_samples: int, epsilon: float, reach: float, per_cell: int) -> DataFrame | None:
    """_trees of the usable vectors of df; keys are key * 2 + field."""
    cells = fit_cells(df, dim, True, per_cell, most=REFINE, block=DEALT, margin=np.inf, deeper=1)
    if cells is None:
        return None

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for b in batches:
            key, m = keyed(b, dim)
            for i in range(0, len(key), 4096):
                x = unit(m[i : i + 4096]).astype(np.float32)
                yield key[i : i + 4096] * 2 + field, x, _eighth(x)

    cells.aq.books = cells.aq.books[: 2 + len(cells.crowded)]
    rows = latest_rows(df, "image_id", "computed_at", ["features"]).mapInArrow(lambda batches: _packed(cells, parts(batches), dim, field), _CELL)
    return _trees(rows, dim, min_samples, epsilon, reach, True)


def _second_search(rows: DataFrame, dim: int, field: int, min_samples: int, epsilon: float, reach: float, per_cell: int) -> DataFrame | None:
    """_trees of rows (key, small) of one field, in cells fitted to them."""
    n = rows.count()
    parts = max(1, n // 120_000)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([fixed_binary(from_binary(b.column("small"), "i1", dim).astype(np.float32))], ["raw"])

    chosen = rows.filter(F.pmod(F.xxhash64("key", F.lit(11)), F.lit(parts)) == 0).select("small").mapInArrow(take, "raw binary")
    cells = fit_rows(chosen, dim, parts, per_cell, most=REFINE, block=DEALT, probes=3, margin=1.3)
    if cells is None:
        return None

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                small = from_binary(part.column("small"), "i1", dim)
                yield np.asarray(part.column("key")), _float(small), small

    cells.aq.books = cells.aq.books[: 2 + len(cells.crowded)]
    return _trees(rows.select("key", "small").mapInArrow(lambda batches: _packed(cells, pieces(batches), dim, field), _CELL), dim, min_samples, epsilon, reach, False)


def _means(parts: DataFrame, dim: int) -> DataFrame:
    """(name, mean BINARY): the unit mean of the sums (name, total) of each name."""

    def add(t: pa.Table) -> pa.Table:
        m = from_binary(t.column("total"), "<f4", dim).astype(np.float64).sum(axis=0)
        return pa.table({"name": t.column("name")[:1], "mean": pa.array([(m / np.sqrt(m @ m)).astype(np.float32).tobytes()], pa.binary())})

    return parts.groupBy("name").applyInArrow(add, "name long, mean binary")


def _bytes_of(means: DataFrame, dim: int) -> DataFrame:
    """(key, small) of means (name, mean)."""

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("name"), fixed_binary(_eighth(from_binary(b.column("mean"), "<f4", dim)))], ["key", "small"])

    return means.select("name", "mean").mapInArrow(small, "key long, small binary")


def _sums(rows: DataFrame, dim: int) -> DataFrame:
    """(name, total) of the vectors of rows (name, small), one row a batch and name."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                names, place = np.unique(np.asarray(b.column("name")), return_inverse=True)
                total = np.zeros((len(names), dim), np.float32)
                np.add.at(total, place, _float(from_binary(b.column("small"), "i1", dim)))
                yield pa.RecordBatch.from_arrays([pa.array(names), fixed_binary(total)], ["name", "total"])

    return rows.select("name", "small").mapInArrow(add, "name long, total binary")


def _nearest_mean(left: DataFrame, means: DataFrame, dim: int, epsilon: float) -> DataFrame:
    """(key, name): the cluster with the nearest mean for each row of left (key, small) that has one within epsilon, ties to the lower name.

    Few means (MEANS, a checked bound) go to every worker; more are dealt to blocks, each of which meets each block of rows.
    """

    def best(keys: np.ndarray, x: np.ndarray, names: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        own = [(keys % 2 == f, names % 2 == f) for f in (0, 1)]
        out = []
        for k, n in own:
            if k.any() and n.any():
                order = np.argsort(names[n])
                d = 1 - x[k] @ c[n][order].T
                at = d.argmin(axis=1)
                low = d[np.arange(len(d)), at]
                on = low <= epsilon
                out.append((keys[k][on], names[n][order][at[on]], low[on].astype(np.float64)))
        empty = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in zip(empty, *out, strict=True)], ["key", "name", "d"])

    schema = "key long, name long, d double"
    n = means.count()
    if n <= MEANS:
        rows = sorted((r["name"], bytes(r["mean"])) for r in means.collect())
        names, c = np.array([r[0] for r in rows], np.int64), np.frombuffer(b"".join(r[1] for r in rows), np.float32).reshape(-1, dim)

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, 2048):
                    part = b.slice(i, 2048)
                    yield best(np.asarray(part.column("key")), _float(from_binary(part.column("small"), "i1", dim)), names, c)

        return left.select("key", "small").mapInArrow(near, schema).select("key", "name")

    def pack(t: pa.Table) -> pa.Table:
        return pa.table({"names": pa.array([t.column("name").to_numpy().tobytes()], pa.binary()), "means": pa.array([b"".join(t.column("mean").to_pylist())], pa.binary())})

    packed = materialise(means.withColumn("g", F.pmod(F.xxhash64("name"), F.lit(-(-n // 4096)))).groupBy("g").applyInArrow(pack, "names binary, means binary"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                yield pa.RecordBatch.from_arrays([pa.array([np.asarray(part.column("key")).tobytes()], pa.binary()), pa.array([from_binary(part.column("small"), "i1", dim).tobytes()], pa.binary())], ["keys", "small"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield best(np.frombuffer(r["keys"], np.int64), _float(np.frombuffer(r["small"], np.int8).reshape(-1, dim)), np.frombuffer(r["names"], np.int64), np.frombuffer(r["means"], np.float32).reshape(-1, dim))

    met = left.select("key", "small").mapInArrow(gather, "keys binary, small binary").hint("shuffle_replicate_nl").join(packed, F.col("keys").isNotNull() & F.col("names").isNotNull())
    return met.mapInArrow(meet, schema).groupBy("key").agg(F.min(F.struct("d", "name")).alias("m")).select("key", F.col("m.name").alias("name"))


class _Part:
    """A part of the hierarchy: n members, `level` (own stability at birth distance h is level - n / h), the best stability of its parts, its least
    core distance, and whether it is a leaf."""

    def __init__(self, n: float, level: float, parts: float, core: float, leaf: bool) -> None:
        self.n, self.level, self.parts, self.core, self.leaf = n, level, parts, core, leaf

    def close(self, h: float, contrast: float) -> tuple[bool, float]:
        """(whether it is kept, best stability) if it is born at distance h."""
        own = self.level - self.n / h
        kept = h >= contrast * self.core and (self.leaf or own > self.parts)
        return kept, own if kept else self.parts


_LEAST = 1e-6


def join_parts(a: _Part, b: _Part, h: float, contrast: float) -> tuple[_Part, bool, bool]:
    """(the part that a and b form at distance h, whether a is kept, whether b is)."""
    (ka, ba), (kb, bb) = a.close(h, contrast), b.close(h, contrast)
    n = a.n + b.n
    return _Part(n, n / h, ba + bb, min(a.core, b.core), False), ka, kb


def condense(leaves: pd.DataFrame, edges: pd.DataFrame, reach: float, contrast: float) -> dict[int, int]:
    """Leaf -> selected cluster (named by one of its leaves), by Kruskal's order in one task.

    leaves: node, n, persist (the sum of 1 / core distance of its n members), core (the least); edges: a, b, w. A cluster's stability is the sum
    over its members of (lambda at which they leave - lambda at its birth), lambda = 1 / distance. From the leaves up, a cluster is kept
    if it is more stable than its best parts together and its birth distance is at least `contrast` times its least core
    distance (less is a ripple of the background). What is never joined is born at `reach`.
    """
    part = {v: _Part(float(n), float(p), 0.0, float(c), True) for v, n, p, c in zip(leaves["node"].tolist(), leaves["n"], leaves["persist"], leaves["core"], strict=True)}
    top, parent, children, kept = {v: v for v in part}, {v: v for v in part}, {}, {}

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for w, a, b in sorted(zip(edges["w"].tolist(), edges["a"].tolist(), edges["b"].tolist(), strict=True)):
        x, y = find(a), find(b)
        if x == y:
            continue
        new = ("inner", len(children))
        part[new], kept[top[x]], kept[top[y]] = join_parts(part[top[x]], part[top[y]], max(w, _LEAST), contrast)
        children[new] = (top[x], top[y])
        parent[y] = x
        top[x] = new
    for v in list(parent):
        c = top[find(v)]
        kept[c] = part[c].close(reach, contrast)[0]
    out, stack = {}, [(c, None) for c in {top[find(v)] for v in parent}]
    while stack:
        c, cluster = stack.pop()
        if cluster is None and kept[c]:
            cluster = c
            while cluster in children:
                cluster = children[cluster][0]
        if c in children:
            stack += [(x, cluster) for x in children[c]]
        elif cluster is not None:
            out[c] = cluster
    return out


def hierarchy(leaves: DataFrame, edges: DataFrame, reach: float, contrast: float, one_task: int = ONE_TASK) -> DataFrame:
    """(node, cluster): as condense. Up to `one_task` edges (a checked bound) go to one task; more are contracted in Borůvka rounds.

    In a round every component chooses its lightest edge. Away from the root of a tree of `choices` the weights don't fall, so each component
    joins what its tree has become as a whole: the round's part of the hierarchy is a chain in the order of the weights. It
    is walked as a sorted stream that holds one part at a time, so neither a hub nor a chain is collected.
    """
    leaves, edges = materialise(leaves.select("node", "n", "persist", "core")), materialise(edges.select("a", "b", "w"))
    if edges.count() <= one_task:

        def all_at_once(own: pd.DataFrame, tied: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(list(condense(own, tied, reach, contrast).items()), columns=["node", "cluster"]).astype("int64")

        ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        tied = leaves.join(maybe_broadcast(ends, 2 * one_task), "node", "left_semi").withColumn("g", F.lit(0))
        alone = leaves.join(maybe_broadcast(ends, 2 * one_task), "node", "left_anti")
        alone = alone.filter(F.lit(reach) >= contrast * F.col("core")).select("node", F.col("node").alias("cluster"))
        return tied.groupBy("g").cogroup(edges.withColumn("g", F.lit(0)).groupBy("g")).applyInPandas(all_at_once, "node long, cluster long").unionByName(alone)

    state = leaves.select("node", F.col("n").cast("double").alias("n"), F.col("persist").alias("level"), F.lit(0.0).alias("parts"), "core", F.lit(True).alias("leaf"), F.col("node").alias("rep"))
    held = leaves.select("node", F.col("node").alias("comp"), F.lit(None).cast("long").alias("cluster"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows root, place (0 the root itself), node, w and state in order -> root, place, node, whether node is kept, whether the chain before it is, and
        the chain's state with it."""
        root, now = None, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                part = _Part(r["n"], r["level"], r["parts"], r["core"], r["leaf"])
                before = own = False
                if r["root"] != root:
                    root, now = r["root"], part
                else:
                    now, before, own = join_parts(now, part, max(r["w"], _LEAST), contrast)
                out.append((root, r["place"], r["node"], own, before, now.n, now.level, now.parts, now.core, now.leaf))
            yield pa.RecordBatch.from_pylist([dict(zip(_WALKED.names, x, strict=True)) for x in out], schema=_WALKED)

    while not edges.isEmpty():
        best, roots = choices(edges, turned(edges))
        tree = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).join(best, "node")
        tree = tree.select("node", "root", "w", F.least("node", "parent").alias("lo"), F.greatest("node", "parent").alias("hi"))
        chain = tree.join(state.drop("rep"), "node").withColumn("place", (F.col("node") != F.col("root")).cast("int"))
        walked = chain.repartition("root").sortWithinPartitions("root", "place", "w", "lo", "hi").select("root", "place", "node", "w", "n", "level", "parts", "core", "leaf")
        # the order within the chain, numbered as it is walked
        walked = materialise(walked.mapInArrow(_numbered(walk), ", ".join(f"{f.name} {_SPARK[str(f.type)]}" for f in _WALKED)))
        last = walked.groupBy("root").agg(F.max(F.when(F.col("chain_kept"), F.col("place") - 1)).alias("j"), F.max_by(F.struct("n", "level", "parts", "core", "leaf"), "place").alias("s"), F.max(F.when(F.col("place") == 1, F.col("chain_kept"))).alias("first_kept"))
        last = materialise(last.join(state.select(F.col("node").alias("root"), F.col("rep").alias("root_rep")), "root"))
        named = walked.join(last.select("root", "j", "first_kept", "root_rep"), "root").join(state.select("node", "rep"), "node")
        kept = F.when((F.col("j") >= 1) & (F.col("place") <= F.col("j")), F.col("root_rep")).when(F.when(F.col("place") == 0, F.col("first_kept")).otherwise(F.col("node_kept")), F.col("rep"))
        named = named.select(F.col("node").alias("comp"), "root", kept.alias("found"))
        held = materialise(held.join(named, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp"), F.coalesce("found", "cluster").alias("cluster")))
        others = state.join(walked.select("node"), "node", "left_anti")
        state = materialise(others.unionByName(last.select(F.col("root").alias("node"), "s.n", "s.level", "s.parts", "s.core", "s.leaf", F.col("root_rep").alias("rep"))))
        smaller = materialise(relabel(edges, roots, "w"))
        forget(edges)
        edges = smaller
    # what no edge joins any more is born at `reach`
    top = state.filter((F.lit(reach) >= contrast * F.col("core")) & (F.col("leaf") | (F.col("level") - F.col("n") / reach > F.col("parts")))).select(F.col("node").alias("comp"), "rep")
    return held.join(top, "comp", "left").select("node", F.coalesce("rep", "cluster").alias("cluster")).filter("cluster is not null")


_WALKED = pa.schema([("root", pa.int64()), ("place", pa.int32()), ("node", pa.int64()), ("node_kept", pa.bool_()), ("chain_kept", pa.bool_()), ("n", pa.float64()), ("level", pa.float64()), ("parts", pa.float64()), ("core", pa.float64()), ("leaf", pa.bool_())])
_SPARK = {"int64": "long", "int32": "int", "bool": "boolean", "double": "double"}


def _numbered(walk):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, place = None, 0
        for b in walk(batches):
            own = np.asarray(b.column("root"))
            places = np.empty(len(own), np.int32)
            for i, r in enumerate(own.tolist()):
                place = place + 1 if r == root else 0
                root = r
                places[i] = place
            yield b.set_column(1, _WALKED.field("place"), pa.array(places))

    return run


def density_clusters(tables: list[DataFrame], dim: int = 64, min_size: int = 5, min_samples: int = 4, epsilon: float = 0.22, reach: float = 0.5, per_cell: int = 128, per_second: int = 1024, contrast: float = 1.5) -> DataFrame:
    """(field INT, key, cluster, core): the cluster (its smallest key) of every clustered vector of each table (field = its place).

    tables (two at most): image_id, features (a list of vectors), computed_at; the newest row of each image counts, other
    columns are ignored. Distances are 1 - cosine of vectors kept to 8 bits a component (about 0.001). Vectors in no
    cluster of `min_size` are strays and have no row; unusable vectors, empty tables neither. Copies are ordinary
    members at distance 0. Clusters may have any density up to `reach`; pieces farther apart never join. A cluster must be born at a distance
    of at least `contrast` times its least core distance.

    Approximate is the neighbour search: vectors meet those of their cells. Pieces of FEW and more members are whole groups within epsilon; they
    are not searched again. A member's lambda is taken as 1 / its core distance.
    """
    spark = tables[0].sparkSession
    parts = [p for i, df in enumerate(tables) if (p := _first_search(df, dim, i, min_samples, epsilon, reach, per_cell)) is not None]
    if not parts:
        return spark.createDataFrame([], "field int, key long, cluster long, core double")
    found = materialise(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))
    # the pieces of a vector (one a cell, two at most) are one
    members = materialise(found.filter("kind = 0").select("x", "y", "w").repartition("x").groupBy("x").agg(F.min("y").alias("p"), F.max("y").alias("q"), F.min("w").alias("core")).withColumnRenamed("x", "key"))
    joined = materialise(components(members.filter("p <> q").select(F.col("p").alias("a"), F.col("q").alias("b"))))
    member = members.join(maybe_broadcast(joined.select(F.col("node").alias("p"), "root")), "p", "left").select("key", "core", F.coalesce("root", "p").alias("node"))
    member = materialise(member)
    small = materialise(member.groupBy("node").count().filter(F.col("count") < FEW).select("node"))
    # a vector of a piece of FEW has one in its first cell too, which kept it
    kept = maybe_broadcast(found.filter("kind = 0 and total is not null").select(F.col("x").alias("key"), F.col("total").alias("small")))
    searched = materialise(member.join(maybe_broadcast(small), "node").join(kept, "key").select("key", "node", "core", "small"))
    # a vector within epsilon of the mean of a large piece belongs to it
    sums = found.filter("kind = 2").select(F.col("x").alias("p"), "total").join(maybe_broadcast(joined.select(F.col("node").alias("p"), "root")), "p", "left").select(F.coalesce("root", "p").alias("node"), "total")
    sums = materialise(sums.join(maybe_broadcast(small), "node", "left_anti"))
    close = materialise(_nearest_mean(searched.select("key", "small"), materialise(_means(sums.withColumnRenamed("node", "name"), dim)), dim, epsilon))
    taken = maybe_broadcast(close)
    member = member.join(taken, "key", "left").select("key", "core", F.coalesce("name", "node").alias("node"))
    searched, all_searched = materialise(searched.join(taken, "key", "left_anti")), searched
    forget(all_searched)
    few = searched.select("key", "node", "core")
    again = [p for i in range(len(tables)) if (p := _second_search(searched.filter(F.col("key") % 2 == i), dim, i, min_samples, epsilon, reach, per_second)) is not None]
    edges = found.filter("kind = 1").select(F.col("x").alias("a"), F.col("y").alias("b"), "w")
    if again:
        second = materialise(again[0] if len(again) == 1 else again[0].unionByName(again[1]))
        lies = second.filter("kind = 0").select(F.col("x").alias("key"), F.col("y").alias("piece"), F.col("w").alias("found"))
        lies = materialise(lies.join(few.select("key", "node"), "key").select("key", "piece", "found", "node"))
        heads = materialise(lies.groupBy("piece").agg(F.min("node").alias("root")))
        met = materialise(components(lies.join(maybe_broadcast(heads), "piece").filter("root <> node").select(F.col("root").alias("a"), F.col("node").alias("b"))))
        cores = materialise(lies.groupBy("key").agg(F.min("found").alias("found")))
        member = member.join(maybe_broadcast(met.withColumnRenamed("root", "met")), "node", "left").join(maybe_broadcast(cores), "key", "left")
        member = materialise(member.select("key", F.least("core", F.coalesce("found", "core")).alias("core"), F.coalesce("met", "node").alias("node")))
        joined = materialise(_compose(joined, met).unionByName(heads.select(F.col("piece").alias("node"), "root").join(met.select(F.col("node").alias("root"), F.col("root").alias("met")), "root", "left").select("node", F.coalesce("met", "root").alias("root"))))
        edges = edges.unionByName(second.filter("kind = 1").select(F.col("x").alias("a"), F.col("y").alias("b"), "w"))
    else:
        member = materialise(member)
    far = materialise(relabel(edges, joined, "w"))
    inverse = 1 / F.greatest("core", F.lit(0.01))
    nodes = materialise(member.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum(inverse).alias("persist"), F.min(F.greatest("core", F.lit(0.01))).alias("core")))
    hooked = boruvka(far, nodes.select("node", "n"), min_size)
    leaf = materialise(nodes.join(hooked, "node", "left").select("node", "n", "persist", "core", F.coalesce("root", "node").alias("leaf")))
    leaves = leaf.groupBy(F.col("leaf").alias("node")).agg(F.sum("n").alias("n"), F.sum("persist").alias("persist"), F.min("core").alias("core")).filter(F.col("n") >= min_size)
    chosen = hierarchy(leaves, relabel(far, hooked, "w"), reach, contrast)
    labels = leaf.join(chosen.select(F.col("node").alias("leaf"), F.col("cluster").alias("name")), "leaf").select("node", "n", "name")
    large = maybe_broadcast(materialise(sums.select("node", F.lit(True).alias("large")).distinct()))  # pieces of the first search
    labels = materialise(labels.join(large, "node", "left").select("node", "name", (F.col("n") >= min_size).alias("solid"), F.coalesce("large", F.lit(False)).alias("large")))
    # the mean of a cluster's solid pieces, or of all its vectors if it has none
    loose = labels.groupBy("name").agg(F.max("solid").alias("any")).filter("not any").select("name", F.lit(True).alias("loose"))
    own = materialise(member.join(maybe_broadcast(labels), "node").select("key", "core", "name", "solid", "large"))
    sums = sums.join(maybe_broadcast(labels.filter("large").select("node", "name")), "node").select("name", "total")
    in_few = own.filter("not large").join(maybe_broadcast(materialise(loose)), "name", "left").filter("solid or loose").select("key", "name")
    means = materialise(_means(sums.unionByName(_sums(searched.select("key", "small").join(in_few, "key"), dim)), dim))
    # a cluster of small pieces whose mean is within epsilon of a larger one's is part of it (its vectors shared no cell with the rest)
    wide = materialise(labels.filter("large").select("name").distinct())
    merged = _nearest_mean(_bytes_of(means.join(wide, "name", "left_anti"), dim), means.join(wide, "name"), dim, epsilon)
    merged = materialise(merged.select(F.col("key").alias("name"), F.col("name").alias("into")))
    member_of = own.filter("solid").select("key", "core", "name")
    left = materialise(searched.select("key", "small", "core").join(own.filter("solid and not large").select("key"), "key", "left_anti"))
    near = _nearest_mean(left, means, dim, epsilon)
    near = near.join(left.select("key", "core"), "key")
    near = near.join(maybe_broadcast(cores), "key", "left").withColumn("core", F.least("core", F.coalesce("found", "core"))) if again else near
    out = member_of.unionByName(near.select("key", "core", "name")).join(maybe_broadcast(merged), "name", "left")
    out = materialise(out.select("key", "core", F.coalesce("into", "name").alias("name")))
    # a vector that joined late may have the smallest key of its cluster
    named = out.groupBy("name").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("size")).filter(F.col("size") >= min_size)
    out = out.join(maybe_broadcast(materialise(named)), "name").select((F.col("key") % 2).cast("int").alias("field"), F.expr("key div 2").alias("key"), F.expr("least div 2").alias("cluster"), "core")
    for used in (found, searched, left, member, members):
        forget(used)
    return out


def describe(clusters: DataFrame, exemplars: int = 3) -> DataFrame:
    """(field, cluster, size, exemplars ARRAY<BIGINT>): each cluster's size and the keys of its most persistent members, ties to the lower key."""
    w = Window.partitionBy("field", "cluster").orderBy("core", "key")
    typical = clusters.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= exemplars)
    typical = typical.groupBy("field", "cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "key"))), lambda s: s["key"]).alias("exemplars"))
    return clusters.groupBy("field", "cluster").agg(F.count(F.lit(1)).alias("size")).join(typical, ["field", "cluster"])
