"""Term-frequency and inverse-document-frequency functions, by name.

tf: f = frequency of the term in the document, size = the document's total frequency.
idf: n = documents, doc_freq = documents with the term, coll_freq = its total frequency.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _safe_ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


TF: dict[str, Callable[[Column, Column], Column]] = {
    "constant": lambda f, size: F.lit(1.0),
    "identity": lambda f, size: f.cast("double"),
    "video_google": lambda f, size: F.try_divide(f, F.floor(size)),
    "simple": lambda f, size: 1 + _safe_ln(f),
    "lucene": lambda f, size: F.when(f >= 0, F.sqrt(f)),
}

IDF: dict[str, Callable[[Column, Column, Column], Column]] = {
    "constant": lambda n, doc_freq, coll_freq: F.lit(1.0),
    "identity": lambda n, doc_freq, coll_freq: doc_freq.cast("double"),
    "video_google": lambda n, doc_freq, coll_freq: _safe_ln(F.try_divide(n, coll_freq)),
    "simple": lambda n, doc_freq, coll_freq: _safe_ln(1 + F.try_divide(n, doc_freq)),
    "lucene": lambda n, doc_freq, coll_freq: 1 + _safe_ln(F.try_divide(n, 1 + doc_freq)),
}


def make_tf(name: str) -> Callable[[Column, Column], Column]:
    if name not in TF:
        raise ValueError(f"unknown tf {name!r}; known: {', '.join(TF)}")
    return TF[name]


def make_idf(name: str) -> Callable[[Column, Column, Column], Column]:
    if name not in IDF:
        raise ValueError(f"unknown idf {name!r}; known: {', '.join(IDF)}")
    return IDF[name]
