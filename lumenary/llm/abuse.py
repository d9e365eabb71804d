"""Scores for abusive, hateful or sexual language: a factorization machine over hashed terms of short stretches of text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenary.session import materialise, maybe_broadcast

#: Bits of the term hash, factors of a term, terms in a stretch and between the starts of two, labelled documents the model is fitted on at most.
BITS, FACTORS, SPAN, STRIDE, MOST_LABELLED = 20, 8, 16, 4, 20_000
#: Labelled documents a term must occur in to be learned; weight decay; characters of the labelled documents together at most.
LEAST, DECAY, MOST_CHARACTERS = 4, 2e-4, 200_000_000
#: Shares of the negative and of the positive marks that may be taken for wrong ones, and the score against its mark from which one is.
DOUBTED, DOUBT = (0.02, 0.2), 1.0

_invisible = re.compile("[­​-‏⁠-⁤﻿]")
#: Cyrillic and Greek letters that look like Latin ones.
_LOOKALIKES = str.maketrans("абвгеёзіїјкмнорсѕтухьαεικνορτυχԁһԛԝ", "abbreeziijkmhopcstyxbaeiknoptuxdhqw")
#: Digits and signs used for letters.
_LEET = str.maketrans("0134578@$!|+", "oieastbasilt")
_spelled = re.compile(r"(?<![a-z\d])[a-z]([ ._\-*/|])[a-z](?:\1[a-z])+(?![a-z\d])")
_masked = re.compile(r"[a-z\d]*[a-z](?:\*+[a-z]*)+|\*+[a-z][a-z*]*")
_leety = re.compile(r"(?<![a-z\d])[a-z\d@$!|+]*(?:[a-z][\d@$!|+]|[\d@$!|+][a-z])[a-z\d@$!|+]*")


def plain(text: str | None) -> str:
    """Lower-case text without invisible signs, lookalike letters, accents and spelled-out words."""
    if not text:
        return ""
    if text.isascii():
        text = text.lower()
    else:
        text = unicodedata.normalize("NFKD", _invisible.sub("", text))
        text = "".join(c for c in text if c.isascii() or not unicodedata.combining(c)).lower().translate(_LOOKALIKES)
    return _spelled.sub(lambda m: m.group().replace(m.group(1), ""), text)


class Words:
    """Words of the labelled texts, by which starred and leet words are read."""

    def __init__(self, words: list[str]) -> None:
        self.all = frozenset(words)
        self.at: dict[tuple[int, int, str], list[str]] = {}
        for w in words:
            for i, c in enumerate(w):
                self.at.setdefault((len(w), i, c), []).append(w)
        self.read: dict[str, str] = {}

    def reveal(self, text: str) -> str:
        """A plain text with its starred and leet words read."""
        if "*" in text:
            text = _masked.sub(lambda m: self.unmask(m.group()), text)
        return _leety.sub(lambda m: self.unleet(m.group()), text)

    def unmask(self, masked: str) -> str:
        if masked not in self.read:
            first = len(masked) - len(masked.lstrip("*"))
            pattern = re.compile(re.escape(masked).replace(r"\*", "[a-z]"))
            fit = next((w for w in self.at.get((len(masked), first, masked[first]), ()) if pattern.fullmatch(w)), None)  # by falling frequency
            if len(self.read) > 100_000:
                self.read.clear()
            self.read[masked] = fit or masked.replace("*", "")
        return self.read[masked]

    def unleet(self, word: str) -> str:
        letters = word.translate(_LEET)
        if letters in self.all:
            return letters
        other = word.replace("1", "l").replace("9", "g").translate(_LEET)
        return other if other in self.all else word


_POWER = np.uint64(0x9E3779B97F4A7C15)
_letter = np.zeros(256, bool)
_letter[[*range(97, 123), *range(128, 256)]] = True
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_POWER), -1, 2**64))
        _powers[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, p, np.uint64))]) for p in (_POWER, inverse)]
    return _powers[0], _powers[1]


def terms(texts: list[str], part: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every word, in order, taking about `part` characters at a time."""
    ends = np.cumsum([len(t) for t in texts])
    cuts = [0, *np.flatnonzero(np.diff(ends // part)) + 1, len(texts)]
    got = [(i + d, h) for i, j in zip(cuts[:-1], cuts[1:], strict=True) for d, h in [_terms(texts[i:j])]]
    return np.concatenate([np.empty(0, np.int64), *(d for d, _ in got)]), np.concatenate([np.empty(0, np.uint64), *(h for _, h in got)])


def _terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """As terms. Letters that repeat count once, so that lengthened words are read."""
    b = np.frombuffer("\n".join([*texts, ""]).encode(), np.uint8)
    if not len(b):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    line = np.cumsum(b == 10)  # only used at ends of texts, see below
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != b[:-1]) | ~_letter[b[1:]] | (b[1:] >= 128)
    at = np.flatnonzero(keep)
    b = b[at]
    word = _letter[b]
    edge = np.diff(np.r_[False, word, False].astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power_tables(len(b) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(b.astype(np.uint64) * up[: len(b)])])
        h = (sums[end] - sums[start]) * down[start]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    ends = np.cumsum([t.count("\n") + 1 for t in texts])
    return np.searchsorted(ends, line[at[start]], side="right"), h


def hashed(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of each word, and of each word with the next, in the model's table."""
    with np.errstate(over="ignore"):
        two = (h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (h[1:] >> np.uint64(7))
        two *= np.uint64(0xD6E8FEB86659FD93)
    shift = np.uint64(64 - BITS)
    return (h >> shift).astype(np.int32), np.r_[(two >> shift).astype(np.int32), np.int32(0)][: len(h)]


def stretches(doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first term, end) of the stretches of SPAN terms, one every STRIDE terms; a document with fewer has one."""
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    each = np.where(count > 0, np.maximum(1, -(-(count - SPAN) // STRIDE) + 1), 0)
    d = np.repeat(np.arange(n), each)
    start = first[d] + STRIDE * (np.arange(len(d)) - np.repeat(np.cumsum(each) - each, each))
    return d, start, np.minimum(start + SPAN, first[d] + count[d])


@dataclass
class FactorizationMachine:
    """score = bias + sum of the terms' weights + sum over pairs of terms of the product of their factors."""

    bias: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((1, FACTORS), np.float32))
    place: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.int32))  # of a term's factors; 0: unknown term, all zero

    def scores(self, one: np.ndarray, two: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Scores of stretches [start, end) of terms, from running sums: a pair's products are (|sum|^2 - sum of |v|^2) / 2."""
        v = self.factors[self.place[one]] + 0.0
        w = self.weights[one].astype(np.float64)
        own = (v * v).sum(axis=1, dtype=np.float64)
        inner = self.factors[self.place[two]]
        own2 = (inner * inner).sum(axis=1, dtype=np.float64)

        def run(x: np.ndarray) -> np.ndarray:
            return np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0, dtype=np.float64)])

        last = np.maximum(end - 1, start)  # pairs of words end one earlier
        s1, s2, q1, q2, l1, l2 = run(v), run(inner), run(own), run(own2), run(w), run(self.weights[two].astype(np.float64))
        total = s1[end] - s1[start] + s2[last] - s2[start]
        square = q1[end] - q1[start] + q2[last] - q2[start]
        return self.bias + l1[end] - l1[start] + l2[last] - l2[start] + 0.5 * ((total * total).sum(axis=1) - square)

    def in_parts(self, one: np.ndarray, two: np.ndarray, start: np.ndarray, end: np.ndarray, part: int = 20_000) -> np.ndarray:
        """As scores, for many stretches in order, with bounded memory."""
        out = [np.empty(0)]
        for i in range(0, len(start), part):
            lo, hi = int(start[i]), int(end[i : i + part].max())
            out.append(self.scores(one[lo:hi], two[lo:hi], start[i : i + part] - lo, end[i : i + part] - lo))
        return np.concatenate(out)

    def fit(self, row: np.ndarray, at: np.ndarray, y: np.ndarray, importance: np.ndarray, epochs: int, rate: float, decay: float, rng: np.random.Generator) -> None:
        """Adagrad on the logistic loss; stretch row[i] has the term at[i] (row ascending, every row present)."""
        seen, at = np.unique(at, return_inverse=True)  # the table's places, numbered densely for the fit
        w, v = np.zeros(len(seen), np.float32), rng.normal(0, 0.03, (len(seen), FACTORS)).astype(np.float32)
        gw, gv, gb = np.full(len(w), 1e-2, np.float32), np.full(v.shape, 1e-2, np.float32), 1e-2
        n = np.bincount(row, minlength=len(y))
        first = np.cumsum(n) - n
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(order), 512):
                part = order[i : i + 512]
                m = n[part]
                cut = np.cumsum(m) - m
                own = np.repeat(np.arange(len(part)), m)
                t = at[np.repeat(first[part] - cut, m) + np.arange(len(own))]
                vt = v[t]
                sums = np.add.reduceat(vt, cut, axis=0)
                score = self.bias + np.add.reduceat(w[t], cut) + 0.5 * ((sums * sums).sum(axis=1) - np.add.reduceat((vt * vt).sum(axis=1), cut))
                g = ((1 / (1 + np.exp(-np.clip(score, -30, 30))) - y[part]) * importance[part]).astype(np.float32)
                by = np.argsort(t, kind="stable")
                t = t[by]
                start = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
                ones = t[start]
                gt = g[own[by]]
                dw = np.add.reduceat(gt, start) + decay * w[ones]
                dv = np.add.reduceat(gt[:, None] * (sums[own[by]] - vt[by]), start, axis=0) + 4 * decay * v[ones]
                gw[ones] += dw * dw
                gv[ones] += dv * dv
                w[ones] -= rate * dw / np.sqrt(gw[ones])
                v[ones] -= 0.5 * rate * dv / np.sqrt(gv[ones])
                db = float(g.sum())
                gb += db * db
                self.bias -= rate * db / gb**0.5
        self.weights[seen] = w
        self.place[seen] = np.arange(1, len(seen) + 1)
        self.factors = np.concatenate([np.zeros((1, FACTORS), np.float32), v])


@dataclass
class Model:
    words: Words
    machine: FactorizationMachine
    limit: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The highest score of a stretch of each text; -inf for a text without words."""
        out = np.full(len(texts), -np.inf)
        doc, h = terms([self.words.reveal(plain(t)) for t in texts])
        if len(h):
            one, two = hashed(h)
            d, start, end = stretches(doc, len(texts))
            np.maximum.at(out, d, self.machine.scores(one, two, start, end))
        return out


def distinct(x: np.ndarray) -> np.ndarray:
    """Different values, ascending; by sorting, which is faster here than hashing."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def _train(doc: np.ndarray, one: np.ndarray, two: np.ndarray, y: np.ndarray, use: np.ndarray, rng: np.random.Generator, rounds: int = 4) -> FactorizationMachine:
    """Fit on documents' labels: a positive document is represented by the stretch that scores highest, a negative one by
    its highest few and some others; these are chosen anew in each round.

    Reviewed marks are partly wrong: in the last two rounds up to DOUBTED of the documents of either mark are left out of the fit (not of
    the scoring, nor of the choice of the limit), if the model of the round before contradicts their mark by more than DOUBT."""
    n = len(y)
    d, start, end = stretches(doc, n)
    on = use[d]
    d, start, end = d[on], start[on], end[on]
    # the first choice: terms by how much more often they occur in positive documents
    size = 1 << BITS
    counts = []
    for sign in (0, 1):
        own = use[doc] & (y[doc] == sign)
        pairs = distinct(np.concatenate([doc[own] * size + one[own], doc[own] * size + two[own]]))
        counts.append(np.bincount(pairs % size, minlength=size))
    p, q = max(1, int((use & (y == 1)).sum())), max(1, int((use & (y == 0)).sum()))
    odds = np.log((counts[1] + 0.1) / (p + 0.2)) - np.log((counts[0] + 0.1) / (q + 0.2))
    known = counts[0] + counts[1] >= LEAST
    odds[~known] = 0
    machine = FactorizationMachine(weights=np.maximum(odds, 0).astype(np.float32) * 0.5)
    trusted = np.ones(n, bool)
    for r in range(rounds):
        s = machine.in_parts(one, two, start, end)
        order = np.lexsort((-s, d))
        lead = np.r_[True, d[order][1:] != d[order][:-1]]
        rank = np.arange(len(order)) - np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))
        if r >= 2:  # the marks that the model contradicts most are taken for wrong ones
            best = np.full(n, np.nan)
            best[d[order][lead]] = s[order][lead]
            trusted[:] = True
            for sign in (0, 1):
                doubt = np.where(use & (y == sign) & np.isfinite(best), best * (1 - 2 * sign), -np.inf)
                worst = np.argsort(-doubt)[: int((use & (y == sign)).sum() * DOUBTED[sign])]
                trusted[worst[doubt[worst] > DOUBT]] = False
        top = order[(rank < 1) | ((rank < 2) & (y[d[order]] == 0))]
        other = rng.choice(len(d), min(len(d), len(top)), replace=False)
        chosen = np.unique(np.r_[top, other[y[d[other]] == 0]])
        chosen = chosen[trusted[d[chosen]]]
        at = start[chosen][:, None] + np.arange(SPAN)
        inside, paired = at < end[chosen][:, None], at < end[chosen][:, None] - 1
        row = np.repeat(np.arange(len(chosen)), SPAN).reshape(at.shape)
        at = np.minimum(at, len(one) - 1)
        row, place = np.r_[row[inside], row[paired]], np.r_[one[at[inside]], two[at[paired]]]
        on = known[place]
        # place 0 stands in each row, so that none is empty
        pair = np.sort(np.r_[row[on] * size + place[on], np.arange(len(chosen)) * size])  # repeated terms count again, as in scores
        z = y[d[chosen]].astype(np.float64)
        machine = FactorizationMachine(bias=-2.0)
        machine.fit(pair // size, pair % size, z, np.where(z == 1, 2.0, 1.0), 2 if r < rounds - 1 else 5, 0.15, DECAY, rng)
        machine.weights[0], machine.place[0] = 0, 0
    return machine


def fit(texts: list[str | None], y: np.ndarray, seed: int = 9) -> Model:
    """Words, machine and limit from labelled texts (y 1 or 0). The limit is that of the best F0.5 on a held-out third:
    reviewed samples hold a larger share of abusive texts than the collection, so precision counts more."""
    rng = np.random.default_rng(seed)
    bare = [plain(t) for t in texts]
    seen: dict[str, int] = {}
    for t in bare:
        for w in set(re.findall(r"[^\W\d_]{2,}", t)):
            seen[w] = seen.get(w, 0) + 1
    words = Words([w for w, c in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if c >= 3])
    doc, h = terms([words.reveal(t) for t in bare])
    one, two = hashed(h)
    d, start, end = stretches(doc, len(y))
    part = rng.random(len(y)) < 1 / 3
    machine = _train(doc, one, two, y, ~part, rng)
    on = part[d]
    held = np.full(len(y), -np.inf)
    np.maximum.at(held, d[on], machine.in_parts(one, two, start[on], end[on]))
    held, true = held[part], y[part]
    order = np.argsort(-held)
    right = np.cumsum(true[order])
    quality = 1.25 * right / (np.arange(1, len(true) + 1) + 0.25 * max(1, true.sum()))
    near = np.flatnonzero(quality >= quality.max() - 0.003)  # the middle of the limits that do about as well
    limit = float(held[order[near[0]]] + held[order[near[-1]]]) / 2
    return Model(words, _train(doc, one, two, y, np.ones(len(y), bool), rng), limit if np.isfinite(limit) else 0.0)


def labelled_texts(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int = MOST_LABELLED, characters: int = MOST_CHARACTERS) -> tuple[list[str], np.ndarray]:
    """Texts and marks of at most `most` labelled documents of at most `characters` in all: those of smallest hash, whole. Repeated marks are decided
    by majority, ties are left out; of several texts under one key the least counts."""
    marks = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key).agg(F.avg(label).alias("_y")).filter("_y <> 0.5")
    marks = materialise(marks.orderBy(F.xxhash64(key), key).limit(most))
    texts = docs.select(key, text).join(maybe_broadcast(marks), key).filter(F.col(text).isNotNull()).groupBy(key, "_y").agg(F.min(text).alias("_t"))
    texts = materialise(texts)
    order = Window.orderBy(F.xxhash64(key), key).rowsBetween(Window.unboundedPreceding, 0)  # `most` numbers at most
    within = texts.select(key, F.length("_t").alias("_n"), F.xxhash64(key).alias("_h")).withColumn("_sum", F.sum("_n").over(order)).filter(F.col("_sum") <= characters)
    rows = texts.join(maybe_broadcast(within.select(key)), key, "left_semi").select("_t", "_y").collect()
    return [r[0] for r in rows], np.array([int(r[1] > 0.5) for r in rows])


def abuse_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", also: str | None = None) -> DataFrame:
    """(key, score DOUBLE, flagged BOOLEAN[, also]) of every document; without words: score null, not flagged. `also` names a column to carry along.

    labels: key and `label` (1, 0; others and nulls are ignored; repeated rows vote). The factorization machine is fitted
    on the driver on at most MOST_LABELLED labelled documents and MOST_CHARACTERS characters, then applied to every stretch of SPAN
    words (one every STRIDE) of every whole text: pairs of words farther apart add nothing to each other. Without
    both kinds of label nothing can be learned: all scores are null and nothing is flagged.
    """
    kept = [also] if also else []
    texts, y = labelled_texts(docs, labels, key, text, label)
    kind = docs.schema[key].dataType.simpleString()
    schema = ", ".join([f"`{key}` {kind}, score double, flagged boolean", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)])
    if not len(y) or y.min() == y.max():
        return docs.select(key, F.lit(None).cast("double").alias("score"), F.lit(False).alias("flagged"), *kept)
    order = sorted(range(len(y)), key=lambda i: (texts[i], y[i]))  # the fit doesn't depend on the order of arrival
    model = docs.sparkSession.sparkContext.broadcast(fit([texts[i] for i in order], y[order]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                s = m.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64(), mask=~np.isfinite(s)), pa.array(s > m.limit), *(part.column(2 + j) for j in range(len(kept)))], [key, "score", "flagged", *kept])

    return docs.select(key, text, *kept).mapInArrow(score, schema)


def rates(scores: DataFrame, by: str) -> DataFrame:
    """(by, documents, flagged, rate): documents and flagged ones of each value of `by`; null is a value of its own. scores: with the column `by`."""
    return scores.groupBy(by).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("flagged").cast("long")).alias("flagged"), F.avg(F.col("flagged").cast("double")).alias("rate"))
