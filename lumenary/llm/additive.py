"""Additive quantisation: residual codebooks of full dimension, beam-search encoding, and cells of similar vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Largest first codebook; words of each later codebook; levels after the two that name the cell.
FIRST, LATER, EXTRA = 512, 256, 2


def _nearest(x: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """The n nearest words of each row (in no order), ties to the lower place."""
    d = x @ (-2 * words.T)
    d += (words * words).sum(axis=1)
    return d.argmin(axis=1)[:, None] if n == 1 else np.argpartition(d, n - 1, axis=1)[:, :n]


def lowest(d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of the n lowest of each row of d in ascending order, ties to the lower place; d is overwritten."""
    rows = np.arange(len(d))
    at, value = np.empty((len(d), n), np.int64), np.empty((len(d), n), d.dtype)
    for i in range(n):
        at[:, i] = d.argmin(axis=1)
        value[:, i] = d[rows, at[:, i]]
        d[rows, at[:, i]] = np.inf
    return at, value


def centred(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Unit rows without their part along `mean` (a unit vector or zeros), scaled to unit length again."""
    y = x - (x @ mean)[:, None] * mean
    return y / np.maximum(np.sqrt((y * y).sum(axis=1, keepdims=True)), np.float32(1e-6))


def train_codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6, equal: bool = False) -> np.ndarray:
    """k-means words of the sample x, of unit length if `equal`; an empty word is put on a random row."""
    k = max(1, min(k, len(x)))
    words = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds if k > 1 else 1):
        at = np.concatenate([_nearest(x[i : i + 8192], words, 1)[:, 0] for i in range(0, len(x), 8192)])
        order = np.argsort(at, kind="stable")
        used, starts = np.unique(at[order], return_index=True)
        words[used] = np.add.reduceat(x[order], starts, axis=0) / np.diff(np.r_[starts, len(x)])[:, None]
        empty = np.setdiff1d(np.arange(k), used)
        words[empty] = x[rng.choice(len(x), len(empty))]
        if equal:
            words /= np.maximum(np.sqrt((words * words).sum(axis=1, keepdims=True)), np.float32(1e-6))
    return words.astype(np.float32)


@dataclass
class AdditiveQuantiser:
    """Codebooks whose words, one of each, add up to an approximation of a unit vector."""

    books: list[np.ndarray]
    beam: int = 4

    @classmethod
    def fit(cls, sample: np.ndarray, cells: int, seed: int = 5, first: int = FIRST, equal: bool = False) -> AdditiveQuantiser:
        """Train on a sample of unit vectors (float32); the first two books have about `cells` combinations. equal: first words of one length."""
        rng = np.random.default_rng(seed)
        k1 = max(1, min(cells, first, len(sample) // 10 or 1))
        sizes = [k1, max(1, min(round(cells / k1), 4096)), *[LATER] * EXTRA]
        rest, books = sample.astype(np.float32), []
        for k in sizes:
            book = train_codebook(rest, k, rng, equal=equal and not books)
            books.append(book)
            for i in range(0, len(rest), 8192):
                rest[i : i + 8192] -= book[_nearest(rest[i : i + 8192], book, 1)[:, 0]]
        return cls(books)

    def encode(self, x: np.ndarray, cells: int = 2, levels: int | None = None, margin: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """(codes int16 [n, levels], cells int64 [n, cells]) by beam search.

        After each level the `beam` best sums survive; the cells are the best different pairs of the first two words.
        A row repeats its first pair for each that is missing or whose squared distance is more than `margin` times the first's.
        """
        n = len(x)
        codes, rest = np.zeros((n, 1, 0), np.int16), x[:, None, :].astype(np.float32)
        found = None
        books = self.books[: levels or len(self.books)]
        for level, book in enumerate(books):
            beams = rest.shape[1]
            norms = (book * book).sum(axis=1)
            d = (rest.reshape(n * beams, -1) @ (-2 * book.T)).reshape(n, beams, -1)
            d += norms
            d += np.einsum("ijk,ijk->ij", rest, rest)[:, :, None]
            flat = d.reshape(n, -1)
            at, value = lowest(flat, min(self.beam, flat.shape[1]))
            who, word = at // len(book), at % len(book)
            if level + 1 < len(books):  # nothing is left to do with the last rest
                rest = (rest if beams == 1 else np.take_along_axis(rest, who[:, :, None], axis=1)) - book[word]
            codes = np.concatenate([np.take_along_axis(codes, who[:, :, None], axis=1), word[:, :, None].astype(np.int16)], axis=2)
            if level == 1 or len(self.books) == 1:
                pair = codes[:, :, 0].astype(np.int64) * len(self.books[1]) + codes[:, :, -1]
                best = pair[:, :cells]
                away = value[:, :cells]
                best = np.where(away <= margin * np.maximum(away[:, :1], 0), best, pair[:, :1])
                found = np.concatenate([best, np.repeat(pair[:, :1], cells - best.shape[1], axis=1)], axis=1)
        return codes[:, 0], found

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, i]] for i, book in enumerate(self.books))

    def scores(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Inner products of queries with the coded vectors by one lookup table a level: [codes, queries]."""
        total = np.zeros((len(codes), len(queries)), np.float32)
        for i, book in enumerate(self.books):
            used, place = np.unique(codes[:, i], return_inverse=True)
            total += (book[used] @ queries.T)[place]
        return total


class Cells:
    """Cells of similar vectors, named by the first two words of their codes, and by one word more wherever a cell would
    hold more than `most` vectors.

    Which cells are crowded is estimated from the codebooks' sample (`total` vectors in all), with one more than was
    seen, so that cells too rare for the sample are refined too where a collection is large. A vector goes to its best
    cell at each step and to the others of the `probes` best (`deeper` from the third word on) that are at most `margin` times as far (squared). Cells
    that all words together leave above `block` vectors are listed with their number of blocks.
    """

    def __init__(self, aq: AdditiveQuantiser, sample: np.ndarray, total: float, most: int, block: int, probes: int = 2, margin: float = np.inf, deeper: int | None = None) -> None:
        self.aq, self.probes, self.margin, self.deeper = aq, probes, margin, deeper or probes
        self.mean: np.ndarray | None = None  # of the sample, if cells are of vectors without it
        self.crowded: list[np.ndarray | None] = []  # by level; None: all cells
        scale = total / max(1, len(sample))
        for level in range(2, len(aq.books) + 1):
            ids, n = self._counted(sample)
            at = ids & 3 == level - 2
            if level < len(aq.books) and (scale > most or ((n[at] + 1) * scale > most).any()):
                self.crowded.append(None if scale > most else ids[at][(n[at] + 1) * scale > most])
            else:
                break
        full = np.ceil(n * scale / block).astype(np.int64)
        self.full, self.parts = ids[full > 1], full[full > 1]

    def _counted(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [self.place(x[i : i + 4096], False)[1] for i in range(0, len(x), 4096)]
        return np.unique(np.concatenate([*found, np.empty(0, np.int64)]), return_counts=True)

    def place(self, x: np.ndarray, coded: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, codes): the cells of each row of x, codes by row (not coded: of two words only); rows of x are unit vectors (float32)."""
        codes, pair = self.aq.encode(x, self.probes, None if coded else 2, self.margin)
        new = np.ones(pair.shape, bool)
        for j in range(1, pair.shape[1]):
            new[:, j] = (pair[:, j : j + 1] != pair[:, :j]).all(axis=1)
        who, value = np.nonzero(new)[0], pair[new]
        second = len(self.aq.books[1])
        rows, cells = [], []
        rest = None
        for level, crowded in enumerate(self.crowded):
            tagged = value << 2 | level
            on = np.ones(len(tagged), bool) if crowded is None else np.isin(tagged, crowded)
            rows.append(who[~on])
            cells.append(tagged[~on])
            who, value = who[on], value[on]
            rest = x[who] - self.aq.books[0][value // second] - self.aq.books[1][value % second] if rest is None else rest[on]
            book = self.aq.books[level + 2]
            d = (rest * rest).sum(axis=1)[:, None] + (book * book).sum(axis=1) - 2 * (rest @ book.T)
            near, away = lowest(d, min(self.deeper, len(book)))
            keep = away <= self.margin * np.maximum(away.min(axis=1, keepdims=True, initial=np.inf), 1e-9)
            row, place = np.nonzero(keep)
            word = near[row, place]
            rest, who, value = rest[row] - book[word], who[row], value[row] * len(book) + word
        rows.append(who)
        cells.append(value << 2 | len(self.crowded))
        return np.concatenate(rows), np.concatenate(cells), codes

    def blocks(self, cell: np.ndarray) -> np.ndarray:
        """How many blocks each of the cells is split into."""
        if not len(self.full):
            return np.ones(len(cell), np.int64)
        at = np.minimum(np.searchsorted(self.full, cell), len(self.full) - 1)
        return np.where(self.full[at] == cell, self.parts[at], 1)
