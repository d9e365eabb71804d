"""Frequency of every distinct term: burst-trie counting with adaptive prefix routes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.session import materialise

#: Entries of a container from which it bursts into a node; terms of a flushed worker trie; sent terms under a prefix from which its route is split, at
#: least; routes that are split at most; characters of the longest prefix that is split, and parts of one that is still too full.
BURST, FLUSH, ROUTE_BURST, ROUTES, DEEPEST, PARTS = 512, 200_000, 512, 20_000, 8, 64


class BurstTrie:
    """Terms with an occurrence and a record counter. Inner nodes branch on one character; a leaf is a small hash
    container of suffixes that becomes a node when it outgrows `burst`. The key "" holds a term that ends at a node."""

    def __init__(self, burst: int = BURST) -> None:
        self.burst, self.root, self.size = burst, {}, 0
        self.leaf: set[int] = {id(self.root)}

    def add(self, term: str, occurrences: int, records: int) -> None:
        node, depth = self.root, 0
        while id(node) not in self.leaf:
            if depth == len(term):
                ends = node.setdefault("", [0, 0])
                self.size += ends[1] == 0 and ends[0] == 0
                ends[0] += occurrences
                ends[1] += records
                return
            nxt = node.get(term[depth])
            if nxt is None:
                nxt = node[term[depth]] = {}
                self.leaf.add(id(nxt))
            node, depth = nxt, depth + 1
        entry = node.get(term[depth:])
        if entry is None:
            node[term[depth:]] = [occurrences, records]
            self.size += 1
            if len(node) > self.burst:
                self._burst(node)
        else:
            entry[0] += occurrences
            entry[1] += records

    def _burst(self, node: dict) -> None:
        entries = list(node.items())
        node.clear()
        self.leaf.discard(id(node))
        for suffix, counts in entries:
            if suffix == "":
                node[""] = counts
                continue
            child = node.get(suffix[0])
            if child is None:
                child = node[suffix[0]] = {}
                self.leaf.add(id(child))
            child[suffix[1:]] = counts
        for first, child in list(node.items()):
            if first and len(child) > self.burst:
                self._burst(child)

    def containers(self) -> Iterator[tuple[str, dict[str, list[int]]]]:
        """(prefix, suffix -> counters) of every leaf, and of every node at which a term ends."""
        stack = [("", self.root)]
        while stack:
            prefix, node = stack.pop()
            if id(node) in self.leaf:
                if node:
                    yield prefix, node
                continue
            for c, child in node.items():
                if c == "":
                    yield prefix, {"": child}
                else:
                    stack.append((prefix + c, child))


def _flush(trie: BurstTrie) -> Iterator[pa.RecordBatch]:
    """The containers of a worker's trie as (terms, occ, rec), some thousands of terms a row."""
    terms, occ, rec = [], [], []
    sizes = [0]
    for prefix, entries in trie.containers():
        for suffix, (o, r) in entries.items():
            terms.append(prefix + suffix)
            occ.append(o)
            rec.append(r)
        if len(terms) - sizes[-1] >= 4096:
            sizes.append(len(terms))
    if len(terms) > sizes[-1]:
        sizes.append(len(terms))
    if terms:
        at = pa.array(np.array(sizes, np.int32))
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(at, x) for x in (pa.array(terms, pa.string()), pa.array(occ, pa.int64()), pa.array(rec, pa.int64()))], ["terms", "occ", "rec"])


def _split_prefixes(sent: DataFrame) -> tuple[set[str], int]:
    """(prefixes under which more than a share of the sent terms lie, characters of the longest): the inner nodes of the merged trie.

    The share is such that at most about ROUTES prefixes of each length qualify, however many terms there are.
    """
    total = sent.agg(F.sum(F.size("terms"))).first()[0] or 0
    per = max(ROUTE_BURST, total // ROUTES)
    terms = sent.select(F.explode("terms").alias("t"))
    prefixes = terms.select(F.explode(F.transform(F.sequence(F.lit(0), F.least(F.length("t"), F.lit(DEEPEST))), lambda n: F.substring("t", F.lit(1), n))).alias("p"))
    full = {r.p for r in prefixes.groupBy("p").count().filter(F.col("count") > per).select("p").collect()}
    return full, max(map(len, full), default=0)


def term_frequencies(records: DataFrame, terms: str) -> DataFrame:
    """(term, occurrences, records): how often every distinct term occurs, and in how many rows of `records`.

    records: one row per record; `terms`: its ARRAY<STRING> column. Null arrays, empty arrays and null terms count
    for nothing; the empty string is a term. Other columns are ignored. An empty table gives an empty result.

    Each worker fills a burst trie over its rows (flushed at FLUSH different terms, so its memory is bounded); the tables are read once. What the
    workers send, already counted, is routed by adaptive prefixes: a prefix under which many sent terms lie is split by the next character, as a trie's
    node that bursts, and from DEEPEST characters on by a hash. The matching subtrees are merged at the end of their route, so
    the number of routes follows that of the different terms.
    """
    records = records.select(F.col(terms).alias("terms"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = BurstTrie()
        for b in batches:
            lists = b.column("terms")
            lengths = np.diff(np.asarray(lists.offsets))
            if lists.null_count:
                lengths = np.where(np.asarray(lists.is_valid()), lengths, 0)
            row = np.repeat(np.arange(len(lists)), lengths)
            codes = lists.flatten().dictionary_encode()
            index = codes.indices
            if index.null_count:
                ok = np.asarray(index.is_valid())
                index, row = np.asarray(index.fill_null(0))[ok], row[ok]
            index = np.asarray(index).astype(np.int64)
            words = codes.dictionary.to_pylist()
            occ = np.bincount(index, minlength=len(words))
            pairs = np.unique(row * max(1, len(words)) + index)
            rec = np.bincount(pairs % max(1, len(words)), minlength=len(words))
            for w, o, r in zip(words, occ.tolist(), rec.tolist(), strict=True):
                if o:
                    trie.add(w, o, r)
            if trie.size >= FLUSH:
                yield from _flush(trie)
                trie = BurstTrie()
        yield from _flush(trie)

    sent = materialise(records.mapInArrow(count, "terms array<string>, occ array<bigint>, rec array<bigint>"))
    full, longest = _split_prefixes(sent)

    def route(term: str) -> str:
        n = 0
        while n <= longest and n <= len(term) and term[:n] in full:
            n += 1
        if n > DEEPEST:
            return f"{term[:DEEPEST]}\0{zlib.crc32(term.encode()) % PARTS}"
        return term[:n]

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for terms_, occ, rec in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                out: dict[str, tuple[list, list, list]] = {}
                for t, o, r in zip(terms_, occ, rec, strict=True):
                    x = out.setdefault(route(t), ([], [], []))
                    x[0].append(t)
                    x[1].append(o)
                    x[2].append(r)
                cols = list(out.values())
                yield pa.RecordBatch.from_arrays([pa.array(list(out)), pa.array([c[0] for c in cols], pa.list_(pa.string())), pa.array([c[1] for c in cols], pa.list_(pa.int64())), pa.array([c[2] for c in cols], pa.list_(pa.int64()))], ["route", "terms", "occ", "rec"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, trie = None, BurstTrie()

        def out() -> Iterator[pa.RecordBatch]:
            for prefix, entries in trie.containers():
                yield pa.RecordBatch.from_arrays([pa.array([prefix + s for s in entries], pa.string()), pa.array([v[0] for v in entries.values()], pa.int64()), pa.array([v[1] for v in entries.values()], pa.int64())], ["term", "occurrences", "records"])

        for b in batches:
            for route, terms_, occ, rec in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if route != at:
                    yield from out()
                    at, trie = route, BurstTrie()
                for t, o, r in zip(terms_, occ, rec, strict=True):
                    trie.add(t, o, r)
        yield from out()

    parts = sent.mapInArrow(routed, "route string, terms array<string>, occ array<bigint>, rec array<bigint>")
    return parts.repartition("route").sortWithinPartitions("route").mapInArrow(merge, "term string, occurrences bigint, records bigint")


def marked(counts: DataFrame, total: int, rare: float = 1 / 400, common: float = 3 / 10) -> DataFrame:
    """counts with `mark`: 'rare' if records / total < rare, 'common' if > common, else null. total 0 marks nothing."""
    share = F.col("records") / F.lit(max(1, total))
    return counts.withColumn("mark", F.when(F.lit(total) == 0, None).when(share < rare, "rare").when(share > common, "common"))


def nearest_words(images: DataFrame, vocabulary: DataFrame, least: float = 0.72, dim: int = 64) -> DataFrame:
    """(image_id, words ARRAY<STRING>): for each image row the word of every usable feature whose best cosine is >= least.

    The vocabulary goes to every worker; it may have at most 100,000 words (a proven bound, else an error).
    Ties go to the lower word_id. Words whose center is unusable match nothing.
    """
    from lumenary.features import FEATURES_PER_IMAGE, keyed
    from lumenary.vectors import unit

    rows = sorted((r.word_id, r.center) for r in vocabulary.filter("word_id is not null").select("word_id", "center").limit(100_001).collect())
    if len(rows) > 100_000:
        raise ValueError("the vocabulary has more than 100,000 words")
    rows = [(w, c) for w, c in rows if c is not None and len(c) == dim and all(x is not None and np.isfinite(x) for x in c) and any(c)]
    names = np.array([str(w) for w, _ in rows], dtype=object)
    centers = unit(np.array([c for _, c in rows], dtype=np.float64)) if rows else np.empty((0, dim))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, m = keyed(b, dim)
            if not len(key) or not len(names):
                continue
            best, cos = np.empty(len(key), np.int64), np.empty(len(key))
            for i in range(0, len(key), 4096):
                s = unit(m[i : i + 4096]) @ centers.T
                best[i : i + 4096] = s.round(9).argmax(axis=1)
                cos[i : i + 4096] = s.max(axis=1)
            ok = cos.round(9) >= least
            image, word = key[ok] // FEATURES_PER_IMAGE, best[ok]
            if not len(image):
                continue
            starts = np.flatnonzero(np.r_[True, image[1:] != image[:-1]])
            offsets = np.r_[starts, len(image)].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(image[starts]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(names[word], pa.string()))], ["image_id", "words"])

    return images.select("image_id", "features").mapInArrow(assign, "image_id bigint, words array<string>")
