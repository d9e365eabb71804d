"""Test passages inside a corpus: Wu-Manber multi-pattern search for seeds, then alignment of the words around them."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a search string, of one for short words, of a block, and of the shift table's index; bytes that one lane searches; words of a seed;
#: characters of all items together.
LENGTH, SHORT, BLOCK, BITS, LANE, SEED, MOST_CHARACTERS = 16, 8, 4, 18, 1024, 4, 16_000_000

_escaped = re.compile(r"\\+[nrtfv]")
_between = re.compile(r"[\W_]+")


def normalised(text: str | None) -> str:
    """Lower-case words (runs of letters and digits) between single spaces; real and escaped line ends part words."""
    if not text:
        return " "
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if "\\" in text:
        text = _escaped.sub(" ", text)
    return f" {_between.sub(' ', text.lower()).strip()} "


class WuManber:
    """Search for many byte strings of at least `length` bytes (LENGTH at most) at once, in many lanes of a text side by side.

    The shift table holds for each block of BLOCK bytes how far a window of `length` bytes that ends in it may move before a string could
    match. Where the shift is 0, the hash of the window's last block and its first two bytes selects the strings of a bucket,
    and all bytes of each are compared.
    """

    def __init__(self, strings: list[bytes], length: int = LENGTH) -> None:
        self.strings, self.length = sorted(set(strings)), length
        m = np.frombuffer(b"".join(s[:length] for s in self.strings), np.uint8).reshape(-1, length)
        self.shift = np.full(1 << BITS, length - BLOCK + 1, np.uint8)
        for end in range(BLOCK, length + 1):
            np.minimum.at(self.shift, self._block(m[:, end - BLOCK : end]), np.uint8(length - end))
        self.bytes = np.frombuffer(b"".join(s.ljust(LENGTH, b"\0") for s in self.strings), "<u8").reshape(-1, 2)
        self.mask = np.frombuffer(b"".join((b"\xff" * len(s)).ljust(LENGTH, b"\0") for s in self.strings), "<u8").reshape(-1, 2)
        bucket = self._bucket(m)
        self.order = np.argsort(bucket, kind="stable")
        self.buckets = bucket[self.order]

    @staticmethod
    def _block(b: np.ndarray) -> np.ndarray:
        k = b.astype(np.uint32)
        k = k[:, 0] | (k[:, 1] << 8) | (k[:, 2] << 16) | (k[:, 3] << 24)
        return (k * np.uint32(2654435761)) >> np.uint32(32 - BITS)

    def _bucket(self, m: np.ndarray) -> np.ndarray:
        """The suffix block and the prefix (after the space at which all strings begin) of windows of `length` bytes."""
        tail = m[:, self.length - BLOCK : self.length].astype(np.uint64)
        key = tail[:, 0] | (tail[:, 1] << np.uint64(8)) | (tail[:, 2] << np.uint64(16)) | (tail[:, 3] << np.uint64(24))
        return key | (m[:, 1].astype(np.uint64) << np.uint64(32)) | (m[:, 2].astype(np.uint64) << np.uint64(40))

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, string numbers) of all occurrences in a uint8 array that ends with LENGTH bytes of zero, by position."""
        last = len(text) - LENGTH
        if last < 0 or not self.strings:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.arange(0, last + 1, LANE)
        end = np.minimum(at + LANE, last + 1)
        hits = []
        tail = np.arange(self.length - BLOCK, self.length)
        while len(at):
            move = self.shift[self._block(text[at[:, None] + tail])]
            zero = move == 0
            hits.append(at[zero & (text[at] == 32)])  # all strings begin at a word
            at = at + np.maximum(move, 1)
            on = at < end
            if not on.all():
                at, end = at[on], end[on]
        at = np.sort(np.concatenate(hits))
        out_at, out_s = [], []
        for i in range(0, len(at), 65536):
            part = at[i : i + 65536]
            m = np.ascontiguousarray(text[part[:, None] + np.arange(LENGTH)])
            b, w = self._bucket(m), m.view("<u8").reshape(-1, 2)
            lo, hi = np.searchsorted(self.buckets, b), np.searchsorted(self.buckets, b, side="right")
            for j in range(0, len(part), 4096):
                n = (hi - lo)[j : j + 4096]
                who = np.repeat(np.arange(j, j + len(n)), n)
                s = self.order[np.repeat(lo[j : j + 4096], n) + np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)] if len(who) else np.empty(0, np.int64)
                same = ((w[who] & self.mask[s]) == self.bytes[s]).all(axis=1)
                out_at.append(part[who[same]])
                out_s.append(s[same])
        return np.concatenate([*out_at, np.empty(0, np.int64)]), np.concatenate([*out_s, np.empty(0, np.int64)])


def longest_passage(agree: np.ndarray, words: int) -> int:
    """Length of the longest stretch of at least `words` places of which four in five agree; 0 if there is none."""
    sums = np.r_[0, np.cumsum(np.where(agree, 1, -4))]
    n = len(agree)
    best = 0
    low = np.minimum.accumulate(sums)  # at each start so far
    for j in range(words, n + 1):
        if low[j - words] <= sums[j]:
            best = max(best, j - int(np.argmax(sums[: j - words + 1] <= sums[j])))
    return best


def aligned_passage(item: list[int], doc: list[int], words: int) -> int:
    """As longest_passage, over an alignment that may skip words on either side (a skip counts as disagreement)."""
    blocks = [b for b in SequenceMatcher(None, item, doc, autojunk=False).get_matching_blocks() if b.size]
    best = 0
    for i, first in enumerate(blocks):
        matches = 0
        for b in blocks[i:]:
            matches += b.size
            length = max(b.a + b.size - first.a, b.b + b.size - first.b)
            if length >= words and 5 * matches >= 4 * length:
                best = max(best, length)
    return best


class Passages:
    """The items' search strings and words, and the search of one batch of texts.

    A seed is the first LENGTH bytes from a word on, where its SEED words fill them, else the SEED words as a whole: so SEED words of an item
    that stand in a text always leave a seed. 25 words of which 20 agree hold a stretch of five or two of four, thus two seeds.
    """

    def __init__(self, items: list[tuple[int, str]], words: int) -> None:
        self.words, self.ids, self.items, self.known = words, [i for i, _ in items], [], {}
        where: dict[bytes, list[tuple[int, int]]] = {}
        for number, (_, text) in enumerate(items):
            norm = normalised(text).encode()
            parts = norm.split()
            self.items.append(np.array([self.known.setdefault(w, len(self.known)) for w in parts], np.int64))
            at = 0
            for place, w in enumerate(parts):
                if place + SEED <= len(parts):
                    size = sum(map(len, parts[place : place + SEED])) + SEED + 1
                    where.setdefault(norm[at : at + min(size, LENGTH)], []).append((number, place))
                at += len(w) + 1
        self.long, self.short = WuManber([s for s in where if len(s) == LENGTH]), WuManber([s for s in where if len(s) < LENGTH], SHORT)
        lists = [where[s] for s in self.long.strings + self.short.strings]
        self.bytes = np.array([len(s) for s in self.long.strings + self.short.strings], np.int64)
        self.first = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int64)
        self.item = np.array([n for x in lists for n, _ in x], np.int64)
        self.place = np.array([p for x in lists for _, p in x], np.int64)
        self.sizes = np.array([len(x) for x in self.items], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate([*self.items, np.zeros(1, np.int64)])

    def find(self, texts: list[str | None]) -> Iterator[tuple[int, int, int]]:
        """(text number, item number, words of the longest passage)."""
        norm = [normalised(t).encode() for t in texts]
        starts = np.r_[0, np.cumsum([len(t) for t in norm])].astype(np.int64)
        buffer = np.frombuffer(b"".join(norm) + bytes(LENGTH), np.uint8)
        (at, s), (short_at, short_s) = self.long.search(buffer), self.short.search(buffer)
        at, s = np.r_[at, short_at], np.r_[s, short_s + len(self.long.strings)]
        if not len(at):
            return
        doc = np.searchsorted(starts, at, side="right") - 1
        on = at + self.bytes[s] <= starts[doc + 1]
        at, s, doc = at[on], s[on], doc[on]
        n = self.first[s + 1] - self.first[s]
        rep = np.repeat(np.arange(len(s)), n)
        pick = np.repeat(self.first[s], n) + np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
        item, place, doc, at = self.item[pick], self.place[pick], doc[rep], at[rep]
        pair = doc * len(self.ids) + item
        held, own = np.unique(doc, return_inverse=True)
        words = [[self.known.get(w, -1) for w in norm[d].split()] for d in held.tolist()]
        first = np.r_[0, np.cumsum([len(w) for w in words])].astype(np.int64)
        flat = np.fromiter((w for x in words for w in x), np.int64, int(first[-1]))
        # the word at which a seed begins: the spaces before it in its text
        spaces = np.cumsum(buffer == 32)
        word = spaces[at] - spaces[starts[doc]]
        best = self._straight(pair, place, word, own, flat, first)
        rest = np.array([p not in best for p in pair.tolist()], bool)
        best |= self._bent(pair[rest], place[rest], word[rest], own[rest], flat, first)
        for p, length in sorted(best.items()):
            yield *divmod(p, len(self.ids)), length

    def _straight(self, pair: np.ndarray, place: np.ndarray, word: np.ndarray, own: np.ndarray, flat: np.ndarray, first: np.ndarray) -> dict[int, int]:
        """Pairs with a passage in which no word is skipped: two seeds at least share its lag, and all places of that lag are compared."""
        lag = word - place
        order = np.lexsort((lag, pair))
        p, g = pair[order], lag[order]
        start = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (g[1:] != g[:-1])])
        start = start[np.diff(np.r_[start, len(p)]) >= 2]
        p, g, o = p[start], g[start], own[order][start]
        item = p % len(self.ids)
        best: dict[int, int] = {}
        for i in range(0, len(p), 4096):
            part = slice(i, i + 4096)
            size = self.sizes[item[part]]
            j = np.arange(int(size.max()))
            at = g[part][:, None] + j
            ok = (j < size[:, None]) & (at >= 0) & (at < (first[o[part] + 1] - first[o[part]])[:, None])
            x = self.flat[np.where(ok, self.starts[item[part]][:, None] + j, 0)]
            y = flat[np.where(ok, first[o[part]][:, None] + at, 0)]
            score = np.where(ok, np.where(x == y, 1, -4), -5 * len(j)).astype(np.int64)
            sums = np.concatenate([np.zeros((len(score), 1), np.int64), np.cumsum(score, axis=1)], axis=1)
            if sums.shape[1] <= self.words:
                continue
            low = np.minimum.accumulate(sums, axis=1)[:, : -self.words]
            for r in np.flatnonzero((low <= sums[:, self.words :]).any(axis=1)).tolist():
                agree, inside = (x[r] == y[r]), ok[r]
                k = int(p[part][r])
                best[k] = max(best.get(k, 0), longest_passage(agree[inside], self.words))
        return best

    def _bent(self, pair: np.ndarray, place: np.ndarray, word: np.ndarray, own: np.ndarray, flat: np.ndarray, first: np.ndarray) -> dict[int, int]:
        """Pairs with a passage in which words are skipped: from one of its seeds' lags to the next there are at most the fifth of its
        length that may disagree, that is a quarter of the item's words."""
        lag = word - place
        order = np.lexsort((lag, pair))
        p, g = pair[order], lag[order]
        best: dict[int, int] = {}
        if not len(p):
            return best
        start = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (g[1:] - g[:-1] > self.sizes[p[1:] % len(self.ids)] // 4 + 1)])
        for x, y in zip(start, np.r_[start[1:], len(p)], strict=True):
            if y - x < 2:
                continue
            at = order[x:y]
            n, o = int(p[x]) % len(self.ids), int(own[at[0]])
            item = self.items[n]
            base, size = first[o], first[o + 1] - first[o]
            lo, hi = max(0, int(word[at].min()) - len(item)), min(size, int(word[at].max()) + len(item))
            doc = flat[base + lo : base + hi]
            # without a stretch of item words that mostly occur near the seeds at all, no alignment can do
            if longest_passage(np.isin(item, doc), self.words * 4 // 5):
                if length := aligned_passage(item.tolist(), doc.tolist(), self.words):
                    best[int(p[x])] = max(best.get(int(p[x]), 0), length)
        return best


def leaked_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", words: int = 25) -> DataFrame:
    """(key, item, passage INT): documents that hold a passage of an item, with the words of the longest one.

    A passage has at least `words` words of the item in the item's order, four in five of which agree. Only words count
    (runs of letters and digits, in lower case); diff marks, comment signs, quotes, spacing and line ends do not, be
    they real or escaped. Null and empty texts hold nothing; an item with fewer than `words` words is never found. Equal documents or
    items are each reported. Items with a null id are left out. Whole texts are searched.

    The items go to every worker; they may have MOST_CHARACTERS characters in all (checked before they are read, else an error; items too
    short to be found don't count).
    """
    known = items.filter(F.col(item).isNotNull() & (F.length("text") >= 2 * words - 1)).select(item, "text")
    if (known.agg(F.sum(F.length("text"))).first()[0] or 0) > MOST_CHARACTERS:
        raise ValueError("the items are too large to be sent to every worker; search them in parts")
    rows = [(r[0], r[1]) for r in known.collect()]
    held: list[Passages] = []

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(Passages(rows, words))
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                got = list(held[0].find(part.column(1).to_pylist()))
                if got:
                    d, n, length = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(d)), pa.array([held[0].ids[x] for x in n], pa.int64()), pa.array(length, pa.int32())], [key, item, "passage"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(search, f"`{key}` {kind}, `{item}` long, passage int")
