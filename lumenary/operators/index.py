"""Inverted index of term histograms: statistics, tf-idf weights, cosine queries, and its four tables on disk."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenary.functions.weighting import make_idf, make_tf
from lumenary.operators.search import DECIMALS, ranked
from lumenary.session import maybe_broadcast


def sparse(histograms: DataFrame, doc: str = "doc_id", histogram: str = "histogram") -> DataFrame:
    """(doc_id, term_id, f): the non-zero bins of dense histograms; null arrays and null bins have no rows."""
    bins = histograms.select(F.col(doc).alias("doc_id"), F.posexplode(histogram).alias("term_id", "f"))
    return bins.filter("f <> 0").withColumn("f", F.col("f").cast("double"))


def tokens(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, term_id STRING, f DOUBLE): how often each run of a-z0-9 occurs in each text, in lower case."""
    words = docs.select(F.col(doc).alias("doc_id"), F.explode(F.split(F.lower(text), "[^a-z0-9]+")).alias("term_id")).filter("term_id <> ''")
    return words.groupBy("doc_id", "term_id").agg(F.count(F.lit(1)).cast("double").alias("f"))


@dataclass
class InvertedIndex:
    """postings (doc_id, term_id, f[, w]), term_stats, doc_stats (every document, also one without terms) and meta (one row)."""

    postings: DataFrame
    term_stats: DataFrame
    doc_stats: DataFrame
    meta: DataFrame

    def save(self, path: str) -> None:
        """Write the four tables; the postings are clustered by term so that a query prunes files."""
        self.postings.repartitionByRange("term_id").sortWithinPartitions("term_id", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        for name in ("term_stats", "doc_stats", "meta"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> InvertedIndex:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "term_stats", "doc_stats", "meta")))


def build_index(postings: DataFrame, docs: DataFrame) -> InvertedIndex:
    """Statistics of postings (doc_id, term_id, f) over the documents `docs` (doc_id).

    term_stats: doc_freq, coll_freq; doc_stats: doc_size, doc_unique (0 without terms); meta: n_docs, avg_size,
    avg_unique, n_terms (averages null without documents). Rows with null or zero f are no postings.
    """
    postings = postings.filter("f <> 0 and term_id is not null").select("doc_id", "term_id", "f")
    term_stats = postings.groupBy("term_id").agg(F.count(F.lit(1)).alias("doc_freq"), F.sum("f").alias("coll_freq"))
    sizes = postings.groupBy("doc_id").agg(F.sum("f").alias("doc_size"), F.count(F.lit(1)).alias("doc_unique"))
    doc_stats = docs.select("doc_id").distinct().join(sizes, "doc_id", "left").select("doc_id", F.coalesce("doc_size", F.lit(0.0)).alias("doc_size"), F.coalesce("doc_unique", F.lit(0)).alias("doc_unique"))
    meta = doc_stats.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_size").alias("avg_size"), F.avg("doc_unique").alias("avg_unique")).crossJoin(term_stats.agg(F.count(F.lit(1)).alias("n_terms")))
    return InvertedIndex(postings, term_stats, doc_stats, meta)


def _normalised(weights: DataFrame, by: Column | str = "doc_id") -> DataFrame:
    """Weights divided by their document's L2 norm; null, NaN and norm 0 give 0."""
    w = F.when(F.isnan("w") | F.col("w").isNull(), 0.0).otherwise(F.col("w"))
    norms = weights.withColumn("w", w)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(by)))
    return norms.withColumn("_norm", norm).withColumn("w", F.when(F.col("_norm") > 0, F.col("w") / F.col("_norm")).otherwise(0.0)).drop("_norm")


def apply_tfidf(index: InvertedIndex, tf: str = "lucene", idf: str = "lucene") -> InvertedIndex:
    """The index with unit-length weights w = tf * idf in its postings; unknown names are errors."""
    t, i = make_tf(tf), make_idf(idf)
    n = F.broadcast(index.meta.select("n_docs"))  # one row
    p = index.postings.select("doc_id", "term_id", "f").join(index.doc_stats.select("doc_id", "doc_size"), "doc_id").join(index.term_stats, "term_id").crossJoin(n)
    w = t(F.col("f"), F.col("doc_size")) * i(F.col("n_docs"), F.col("doc_freq"), F.col("coll_freq"))
    weights = _normalised(p.select("doc_id", "term_id", "f", w.alias("w")))
    return InvertedIndex(weights, index.term_stats, index.doc_stats, index.meta)


def query_weights(index: InvertedIndex, query: DataFrame, tf: str, idf: str) -> DataFrame:
    """(term_id, w): the query's (term_id, f) weighted by the collection's idf and scaled to unit length.

    Under idf simple and video_google a term that no document holds has an infinite idf, which leaves every other weight
    at 0; the other idfs take it as a term of document frequency 0.
    """
    t, i = make_tf(tf), make_idf(idf)
    q = query.filter("f <> 0").select("term_id", F.col("f").cast("double").alias("f"))
    q = q.withColumn("doc_size", F.sum("f").over(Window.partitionBy(F.lit(1))))  # one query
    q = q.join(index.term_stats, "term_id", "left").crossJoin(F.broadcast(index.meta.select("n_docs")))
    unknown = F.col("doc_freq").isNull()
    w = t(F.col("f"), F.col("doc_size")) * i(F.col("n_docs"), F.coalesce("doc_freq", F.lit(0)), F.coalesce("coll_freq", F.lit(0.0)))
    q = q.select("term_id", unknown.alias("_unknown"), w.alias("w"), F.lit(1).alias("_one"))
    if idf in ("simple", "video_google"):
        spoilt = F.max("_unknown").over(Window.partitionBy("_one"))
        q = q.withColumn("w", F.when(spoilt, 0.0).otherwise(F.col("w")))
    return _normalised(q, "_one").select("term_id", "w")


def query_index(index: InvertedIndex, query: DataFrame, k: int, tf: str = "lucene", idf: str = "lucene") -> DataFrame:
    """(rank, score, doc_id): the k documents of greatest cosine with the query (term_id, f); ties go to the higher doc_id.

    Documents that share no term have score 0 and are part of the result. `index` must have weights.
    The query's terms are broadcast to the postings if a count proves them few. Scores are rounded to 9 decimals.
    """
    q = maybe_broadcast(query_weights(index, query, tf, idf).withColumnRenamed("w", "_q"))
    scores = index.postings.join(q, "term_id").groupBy("doc_id").agg(F.sum(F.col("w") * F.col("_q")).alias("s"))
    every = index.doc_stats.select("doc_id").join(scores, "doc_id", "left").select(F.round(F.coalesce("s", F.lit(0.0)), DECIMALS).alias("score"), "doc_id")
    return ranked(every, k, F.col("score").desc(), F.col("doc_id").desc()).select("rank", "score", "doc_id")


def query_index_batched(index: InvertedIndex, queries: DataFrame, k: int, tf: str = "lucene", idf: str = "lucene") -> DataFrame:
    """(query, rank, score, doc_id): as query_index for each query of `queries` (query, term_id, f), but only documents that share a term have rows.

    One join of all queries' terms with the postings; scores are added up before the top k of a query is taken.
    """
    t, i = make_tf(tf), make_idf(idf)
    q = queries.filter("f <> 0").select("query", "term_id", F.col("f").cast("double").alias("f"))
    size = q.groupBy("query").agg(F.sum("f").alias("doc_size"))
    q = q.join(size, "query").join(index.term_stats, "term_id", "left").crossJoin(F.broadcast(index.meta.select("n_docs")))  # one row
    w = t(F.col("f"), F.col("doc_size")) * i(F.col("n_docs"), F.coalesce("doc_freq", F.lit(0)), F.coalesce("coll_freq", F.lit(0.0)))
    q = q.select("query", "term_id", F.when(F.isnan(w) | w.isNull(), 0.0).otherwise(w).alias("_w"), F.col("doc_freq").isNull().alias("_unknown"))
    about = q.groupBy("query").agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"), F.max("_unknown").alias("_spoilt"))
    if idf in ("simple", "video_google"):
        about = about.withColumn("_norm", F.when(F.col("_spoilt"), float("inf")).otherwise(F.col("_norm")))
    q = q.join(about.filter("_norm > 0"), "query").select("query", "term_id", (F.col("_w") / F.col("_norm")).alias("_q"))
    scores = index.postings.join(maybe_broadcast(q), "term_id").groupBy("query", "doc_id").agg(F.round(F.sum(F.col("w") * F.col("_q")), DECIMALS).alias("score"))
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").desc())
    return scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query", "rank", "score", "doc_id")
