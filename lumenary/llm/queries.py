"""Registered queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenary import features
from lumenary.llm import abuse, density, leakage, near_duplicates, neighbours, packing, reservoir, term_counts
from lumenary.operators.latest import latest_rows
from lumenary.session import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def p2_sample(spark: SparkSession, folder: str) -> DataFrame:
    """1,000 of the usable shog features, each with the same chance."""
    features = reservoir.usable_local_features(table(spark, folder, "shog"))
    return reservoir.reservoir_sample(features, ["image_id", "n"], "piece", 1000)


@query
def p2_tenth(spark: SparkSession, folder: str) -> DataFrame:
    """A tenth of the usable shog features, each with the same chance: a reservoir that grows with the data."""
    features = materialise(reservoir.usable_local_features(table(spark, folder, "shog")))
    return reservoir.reservoir_sample(features, ["image_id", "n"], "piece", features.count() // 10)


def _word_counts(spark: SparkSession, folder: str) -> DataFrame:
    galif, vocabulary = table(spark, folder, "galif"), table(spark, folder, "vocabulary")
    images = latest_rows(galif, "image_id", "computed_at", ["features"])
    counts = term_counts.term_frequencies(term_counts.nearest_words(images, vocabulary), "words")
    total = galif.select("image_id").distinct().count()
    # one row for each word of the vocabulary, which is bounded
    words = vocabulary.filter("word_id is not null").select("word_id").distinct()
    both = words.join(counts, words.word_id.cast("string") == counts.term, "left").select("word_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("occurrences", "records")])
    return term_counts.marked(both, total)


@query
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The words of the vocabulary that are too rare or too common among the images of galif."""
    return _word_counts(spark, folder).filter("mark is not null").select("word_id", "mark")


@query
def p5_word_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How often each word occurs and in how many images."""
    return _word_counts(spark, folder)


@query
def p5_source_terms(spark: SparkSession, folder: str) -> DataFrame:
    """How often every term of documents occurs and in how many documents."""
    docs = table(spark, folder, "documents").select(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda t: t != "").alias("terms"))
    return term_counts.term_frequencies(docs, "terms")


ORACLES["p5_source_terms"] = """
WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS term FROM documents)
SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS records FROM t WHERE term <> '' GROUP BY term
"""

ORACLES["p5_word_counts"] = """
WITH ranked AS (SELECT image_id, features, row_number() OVER (PARTITION BY image_id ORDER BY computed_at DESC) AS r FROM galif),
f AS (SELECT image_id, unnest(features) AS v FROM ranked WHERE r = 1),
u AS (SELECT row_number() OVER () AS fid, image_id, CAST(v AS DOUBLE[]) AS v FROM f
      WHERE v IS NOT NULL AND len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(v, lambda x: x <> 0)) > 0),
c AS (SELECT fid, image_id, word_id, round(list_cosine_similarity(v, CAST(center AS DOUBLE[])), 9) AS s FROM u, vocabulary),
b AS (SELECT fid, image_id, word_id, s, row_number() OVER (PARTITION BY fid ORDER BY s DESC, word_id) AS r FROM c),
n AS (SELECT word_id, count(*) AS occurrences, count(DISTINCT image_id) AS records FROM b WHERE r = 1 AND s >= 0.72 GROUP BY word_id),
w AS (SELECT v.word_id, CAST(coalesce(occurrences, 0) AS BIGINT) AS occurrences, CAST(coalesce(records, 0) AS BIGINT) AS records,
             (SELECT count(DISTINCT image_id) FROM galif) AS total FROM vocabulary v LEFT JOIN n USING (word_id))
SELECT word_id, occurrences, records, CASE WHEN 400 * records < total THEN 'rare' WHEN 10 * records > 3 * total THEN 'common' END AS mark FROM w
"""
ORACLES["p5_found"] = f"SELECT word_id, mark FROM ({ORACLES['p5_word_counts']}) WHERE mark IS NOT NULL"


@query
def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every text of documents in containers of 2,048 tokens: which part lies where."""
    docs = table(spark, folder, "documents")
    return packing.pack(packing.token_counts(docs), "doc_id", "tokens", 2048, rows=docs.count())


@query
def p6_totals(spark: SparkSession, folder: str) -> DataFrame:
    """What the packing must keep: every document is there, no container is too full, no document that fits is split."""
    parts = materialise(p6_containers(spark, folder))
    over = parts.groupBy("container").agg(F.sum("tokens").alias("n")).filter("container is not null and n > 2048").agg(F.count(F.lit(1)).alias("overfull"))
    split = parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("tokens").alias("n"))
    split = split.agg(F.count(F.lit(1)).alias("documents"), F.count(F.when((F.col("n") <= 2048) & (F.col("parts") > 1), 1)).alias("needlessly_split"))
    return split.crossJoin(over)  # one row each


ORACLES["p6_totals"] = "SELECT count(DISTINCT doc_id) AS documents, 0::BIGINT AS needlessly_split, 0::BIGINT AS overfull FROM documents"


def _gist_classes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    vectors = features.global_features(table(spark, folder, "gist"))
    return near_duplicates.similar_classes(vectors, 768, 0.97, 0.86)


@query
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of images whose gist vectors have a cosine of at least 0.97."""
    pairs = near_duplicates.all_pairs(*_gist_classes(spark, folder))
    return pairs.select(F.col("a").alias("image_a"), F.col("b").alias("image_b"))


ORACLES["p1_found"] = """
WITH r AS (SELECT image_id, CAST(features AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY image_id ORDER BY computed_at DESC) AS r FROM gist),
u AS (SELECT image_id, v FROM r WHERE r = 1 AND v IS NOT NULL AND len(v) = 768
      AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0)
SELECT a.image_id AS image_a, b.image_id AS image_b FROM u a JOIN u b ON a.image_id < b.image_id WHERE round(list_cosine_similarity(a.v, b.v), 9) >= 0.97
"""


def _neighbours(spark: SparkSession, folder: str) -> DataFrame:
    gist = neighbours.nearest_neighbours(table(spark, folder, "gist"), 768, False, 5, 0.80, sketch=128)
    galif = neighbours.nearest_neighbours(table(spark, folder, "galif"), 64, True, 5, 0.99)
    return gist.withColumn("field", F.lit("gist")).unionByName(galif.withColumn("field", F.lit("galif")))


@query
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair in which one vector is among the five most similar others of the other."""
    found = _neighbours(spark, folder)
    return found.select("field", F.least("key", "other").alias("key_a"), F.greatest("key", "other").alias("key_b")).distinct()


def _clusters(spark: SparkSession, folder: str) -> DataFrame:
    return density.density_clusters([table(spark, folder, "galif"), table(spark, folder, "shog")])


def _field() -> Column:
    return F.when(F.col("field") == 0, "galif").otherwise("shog").alias("field")


@query
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The cluster of every clustered feature of galif and shog."""
    return _clusters(spark, folder).select(_field(), F.col("cluster").alias("cluster_key"), F.col("key").alias("feature_key"))


@query
def p4_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Size and most typical features of every cluster of galif and shog features."""
    found = density.describe(materialise(_clusters(spark, folder)))
    return found.select(_field(), F.col("cluster").alias("cluster_key"), "size", "exemplars")


@query
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item."""
    return leakage.leaked_items(table(spark, folder, "documents"), table(spark, folder, "benchmark")).select("doc_id", "item_id")


def _abuse(spark: SparkSession, folder: str, also: str | None = None) -> DataFrame:
    return abuse.abuse_scores(table(spark, folder, "documents"), table(spark, folder, "labels"), also=also)


@query
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with abusive, hateful or sexually explicit language."""
    return _abuse(spark, folder).filter("flagged").select("doc_id")


@query
def p8_source_rates(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents of each source are flagged."""
    return abuse.rates(_abuse(spark, folder, "source"), "source")


@query
def p8_source_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The scored documents of each source: none is left out."""
    return p8_source_rates(spark, folder).select("source", "documents")


ORACLES["p8_source_documents"] = "SELECT source, count(*) AS documents FROM documents GROUP BY source"
