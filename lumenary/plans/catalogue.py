"""Registered queries of the core operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenary.functions import distances
from lumenary.operators import index, kmeans, quantise, sampling, search
from lumenary.operators.latest import latest_rows
from lumenary.session import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Nearest neighbours: the query is the vector of id 0.


def _vectors(spark: SparkSession, folder: str, positive: bool = False) -> DataFrame:
    v = F.transform("embedding", lambda x: F.abs(x.cast("double")) if positive else x.cast("double"))
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("key"), v.alias("vector"))


_E = "SELECT vec_id AS key, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
_P = "SELECT vec_id AS key, list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x)) AS v FROM embeddings"


def _pairwise(expression: str) -> str:
    return f"list_sum(list_transform(list_zip(q.v, b.v), lambda t: {expression}))"


_DISTANCE_SQL = {
    "l1norm": (_E, _pairwise("abs(t[1] - t[2])")),
    "l2norm_squared": (_E, _pairwise("(t[1] - t[2]) * (t[1] - t[2])")),
    "l2norm": (_E, f"sqrt({_pairwise('(t[1] - t[2]) * (t[1] - t[2])')})"),
    "one_minus_dot": (_E, f"1 - {_pairwise('t[1] * t[2]')}"),
    "jsd": (_P, _pairwise("CASE WHEN t[1] > 0 THEN t[1] * ln(2 * t[1] / (t[1] + t[2])) ELSE 0 END + CASE WHEN t[2] > 0 THEN t[2] * ln(2 * t[2] / (t[1] + t[2])) ELSE 0 END")),
    "chi2": (_P, _pairwise(f"(t[1] - t[2]) * (t[1] - t[2]) / (t[1] + t[2] + {distances.CHI2_EPSILON})")),
    "df": (_E, "list_sum(list_transform(list_zip(q.v[1:32], b.v[33:64]), lambda t: t[1] * t[2])) + list_sum(list_transform(list_zip(b.v[1:32], q.v[33:64]), lambda t: t[1] * t[2]))"),
    "frobenius": (_E, "list_sum(list_transform(range(0, 21), lambda i: sqrt((q.v[3*i+1]-b.v[3*i+1])**2 + 2 * (q.v[3*i+2]-b.v[3*i+2])**2 + (q.v[3*i+3]-b.v[3*i+3])**2)))"),
}


def _knn_sql(vectors: str, d: str, k: int | None) -> str:
    limit = "" if k is None else f"WHERE rank <= {k}"
    return f"""
WITH e AS ({vectors}), n AS (SELECT round({d}, 9) AS distance, b.key FROM e b, (SELECT v FROM e WHERE key = 0) q),
r AS (SELECT CAST(row_number() OVER (ORDER BY distance, key) AS INTEGER) AS rank, distance, key FROM n)
SELECT rank, distance, key FROM r {limit}"""


def _knn(name: str, positive: bool, k: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        base = _vectors(spark, folder, positive)
        return search.linear_search(base, base.filter("key = 0"), k, name)

    return run


for _name, (_source, _sql) in _DISTANCE_SQL.items():
    query(_knn_sql(_source, _sql, 25), f"knn_{_name}")(_knn(_name, _source is _P, 25))


@query(
    _knn_sql(_E, "list_sum(list_transform(range(0, 21), lambda i: CASE WHEN i % 3 = 0 THEN 0 ELSE sqrt((q.v[3*i+1]-b.v[3*i+1])**2 + 2 * (q.v[3*i+2]-b.v[3*i+2])**2 + (q.v[3*i+3]-b.v[3*i+3])**2) END))", 25)
)
def knn_frobenius_masked(spark: SparkSession, folder: str) -> DataFrame:
    """Every third triple of the query is masked."""
    base = _vectors(spark, folder)
    mask = F.array(*[F.lit(i % 3 == 0) for i in range(21)])
    return search.linear_search(base, base.filter("key = 0"), 25, distances.frobenius(mask))


@query(_knn_sql(_E, _DISTANCE_SQL["l2norm"][1], None))
def topk_larger_than_n(spark: SparkSession, folder: str) -> DataFrame:
    """k beyond the number of rows gives all rows."""
    base = _vectors(spark, folder)
    return search.linear_search(base, base.filter("key = 0"), 1_000_000, "l2norm")


_USABLE_GIST = """
SELECT image_id AS key, CAST(features AS DOUBLE[]) AS v FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY computed_at DESC) AS r FROM gist)
WHERE r = 1 AND features IS NOT NULL AND len(features) = 768
  AND len(list_filter(features, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(features, lambda x: x <> 0)) > 0"""


def _gist(spark: SparkSession, folder: str) -> DataFrame:
    rows = latest_rows(table(spark, folder, "gist"), "image_id", "computed_at", ["features"])
    finite = F.forall("features", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("features", lambda v: v != 0)
    return rows.filter((F.size("features") == 768) & finite).select(F.col("image_id").alias("key"), F.col("features").cast("array<double>").alias("vector"))


@query(f"""
WITH e AS ({_USABLE_GIST}), n AS (SELECT round(list_distance(q.v, b.v), 9) AS distance, b.key FROM e b, (SELECT v FROM e ORDER BY key LIMIT 1) q),
r AS (SELECT CAST(row_number() OVER (ORDER BY distance, key) AS INTEGER) AS rank, distance, key FROM n)
SELECT rank, distance, key FROM r WHERE rank <= 50""")
def knn_gist(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 images nearest to the first usable one by their global descriptors."""
    base = _gist(spark, folder)
    return search.linear_search(base, base.orderBy("key"), 50, "l2norm")


@query(f"""
WITH e AS ({_E}), n AS (SELECT q.key AS query, round({_DISTANCE_SQL['l2norm'][1]}, 9) AS distance, b.key FROM e b, (SELECT * FROM e WHERE key % 50 = 0) q),
r AS (SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, key) AS INTEGER) AS rank, distance, key FROM n)
SELECT query, rank, distance, key FROM r WHERE rank <= 10""")
def knn_batched_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 50, against all rows."""
    base = _vectors(spark, folder)
    queries = base.filter("key % 50 = 0").select(F.col("key").alias("query"), "vector")
    return search.batched_search(base, queries, 10, "l2norm")


@query(_knn_sql(_E, _DISTANCE_SQL["l2norm"][1], 25))
def knn_incremental_merge(spark: SparkSession, folder: str) -> DataFrame:
    """The top k of two halves, merged, is the top k of all."""
    base = _vectors(spark, folder)
    q = base.filter("key = 0")
    old, new = (search.linear_search(base.filter(F.col("key") % 2 == i), q, 25, "l2norm") for i in (0, 1))
    return search.merge_results(old, new, 25)


# Inverted index: suppliers are documents, parts are terms, quantities are frequencies.


def _postings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("doc_id"), F.col("l_partkey").alias("term_id")).agg(F.sum("l_quantity").alias("f"))
    return p, table(spark, folder, "supplier").select(F.col("s_suppkey").alias("doc_id"))


_POSTINGS = """p AS (SELECT l_suppkey AS doc_id, l_partkey AS term_id, sum(l_quantity) AS f FROM lineitem GROUP BY ALL HAVING sum(l_quantity) <> 0),
ts AS (SELECT term_id, count(*) AS doc_freq, sum(f) AS coll_freq FROM p GROUP BY term_id),
ds AS (SELECT s_suppkey AS doc_id, coalesce(sum(f), 0) AS doc_size, count(f) AS doc_unique FROM supplier LEFT JOIN p ON s_suppkey = doc_id GROUP BY s_suppkey)"""


@query(f"WITH {_POSTINGS} SELECT * FROM p")
def postings_sparse(spark: SparkSession, folder: str) -> DataFrame:
    return index.build_index(*_postings(spark, folder)).postings


@query(f"WITH {_POSTINGS} SELECT * FROM ts")
def term_stats(spark: SparkSession, folder: str) -> DataFrame:
    return index.build_index(*_postings(spark, folder)).term_stats


@query(f"WITH {_POSTINGS} SELECT * FROM ds")
def doc_stats(spark: SparkSession, folder: str) -> DataFrame:
    return index.build_index(*_postings(spark, folder)).doc_stats


@query(f"WITH {_POSTINGS} SELECT count(*) AS n_docs, avg(doc_size) AS avg_size, avg(doc_unique) AS avg_unique, (SELECT count(*) FROM ts) AS n_terms FROM ds")
def index_meta(spark: SparkSession, folder: str) -> DataFrame:
    return index.build_index(*_postings(spark, folder)).meta


_TF_SQL = {"constant": "1.0::DOUBLE", "identity": "f", "video_google": "f / floor(doc_size)", "simple": "1 + ln(f)", "lucene": "sqrt(f)"}
_IDF_SQL = {"constant": "1.0::DOUBLE", "identity": "doc_freq::DOUBLE", "video_google": "ln(n / coll_freq)", "simple": "ln(1 + n / doc_freq)", "lucene": "1 + ln(n / (1 + doc_freq))"}


def _weights_sql(tf: str, idf: str) -> str:
    return f"""{_POSTINGS},
x AS (SELECT doc_id, term_id, f, ({_TF_SQL[tf]}) * ({_IDF_SQL[idf]}) AS w0 FROM p JOIN ds USING (doc_id) JOIN ts USING (term_id), (SELECT count(*)::DOUBLE AS n FROM ds)),
w AS (SELECT doc_id, term_id, f, CASE WHEN sqrt(sum(w0 * w0) OVER (PARTITION BY doc_id)) > 0 THEN w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY doc_id)) ELSE 0 END AS w FROM x)"""


def _weights(tf: str, idf: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        weighted = index.apply_tfidf(index.build_index(*_postings(spark, folder)), tf, idf)
        return weighted.postings.select("doc_id", "term_id", F.round("w", 9).alias("w"))

    return run


def _bof(tf: str, idf: str, k: int, unknown: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        p, docs = _postings(spark, folder)
        weighted = index.apply_tfidf(index.build_index(p, docs), tf, idf)
        q = p.filter("doc_id = 1").select("term_id", "f")
        if unknown:
            q = q.unionByName(spark.sql("SELECT -1L AS term_id, 2.0D AS f"))
        return index.query_index(weighted, q, k, tf, idf)

    return run


def _bof_sql(tf: str, idf: str, k: int | None, unknown: bool = False) -> str:
    # a term that no document holds adds to the query's size and norm, or spoils the query under an infinite idf
    extra = "UNION ALL SELECT -1, 2.0" if unknown else ""
    spoilt = "0 *" if unknown and idf in ("simple", "video_google") else ""
    unknown_idf = {"constant": "1.0", "identity": "0.0", "lucene": "1 + ln(n)", "simple": "0.0", "video_google": "0.0"}[idf]
    where = "" if k is None else f"WHERE rank <= {k}"
    return f"""WITH {_weights_sql(tf, idf)},
q0 AS (SELECT term_id, f FROM p WHERE doc_id = 1 {extra}),
q1 AS (SELECT term_id, f, (SELECT sum(f) FROM q0) AS doc_size, doc_freq, coll_freq, (SELECT count(*)::DOUBLE FROM ds) AS n FROM q0 LEFT JOIN ts USING (term_id)),
q2 AS (SELECT term_id, {spoilt} (({_TF_SQL[tf]}) * CASE WHEN doc_freq IS NULL THEN {unknown_idf} ELSE {_IDF_SQL[idf]} END) AS w0 FROM q1),
q3 AS (SELECT term_id, CASE WHEN (SELECT sum(w0 * w0) FROM q2) > 0 THEN w0 / sqrt((SELECT sum(w0 * w0) FROM q2)) ELSE 0 END AS qw FROM q2),
s AS (SELECT ds.doc_id, round(coalesce(sum(w * qw), 0), 9) AS score FROM ds LEFT JOIN (SELECT doc_id, w, qw FROM w JOIN q3 USING (term_id)) m USING (doc_id) GROUP BY ds.doc_id),
r AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, doc_id DESC) AS INTEGER) AS rank, score, doc_id FROM s)
SELECT rank, score, doc_id FROM r {where}"""


for _name in _TF_SQL:
    query(f"WITH {_weights_sql(_name, _name)} SELECT doc_id, term_id, round(w, 9) AS w FROM w", f"tfidf_weights_{_name}")(_weights(_name, _name))
    query(_bof_sql(_name, _name, 20), f"bof_{_name}")(_bof(_name, _name, 20))
    query(_bof_sql(_name, _name, 20, True), f"bof_oov_{_name}")(_bof(_name, _name, 20, True))
query(_bof_sql("lucene", "lucene", None), "bof_zero_score_fill")(_bof("lucene", "lucene", 1_000_000))


@query("""
WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS term_id FROM documents),
p AS (SELECT doc_id, term_id, count(*)::DOUBLE AS f FROM t WHERE term_id <> '' GROUP BY ALL),
ts AS (SELECT term_id, count(*) AS doc_freq FROM p GROUP BY term_id), n AS (SELECT count(*)::DOUBLE AS n FROM documents),
x AS (SELECT doc_id, term_id, sqrt(f) * (1 + ln(n / (1 + doc_freq))) AS w0 FROM p JOIN ts USING (term_id), n),
w AS (SELECT doc_id, term_id, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY doc_id)) AS w FROM x),
q0 AS (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS term_id FROM benchmark WHERE item_id = 1),
q1 AS (SELECT term_id, count(*)::DOUBLE AS f FROM q0 WHERE term_id <> '' GROUP BY ALL),
q2 AS (SELECT term_id, sqrt(f) * (1 + ln(n / (1 + coalesce(doc_freq, 0)))) AS w0 FROM q1 LEFT JOIN ts USING (term_id), n),
q3 AS (SELECT term_id, w0 / sqrt((SELECT sum(w0 * w0) FROM q2)) AS qw FROM q2),
s AS (SELECT d.doc_id, round(coalesce(sum(w * qw), 0), 9) AS score FROM documents d LEFT JOIN (SELECT doc_id, w, qw FROM w JOIN q3 USING (term_id)) m USING (doc_id) GROUP BY d.doc_id),
r AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, doc_id DESC) AS INTEGER) AS rank, score, doc_id FROM s)
SELECT rank, score, doc_id FROM r WHERE rank <= 50""")
def bof_text(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 documents most similar to the first benchmark item by their words."""
    docs = table(spark, folder, "documents")
    p = materialise(index.tokens(docs))  # read by the statistics and the weights
    weighted = index.apply_tfidf(index.build_index(p, docs))
    item = table(spark, folder, "benchmark").filter("item_id = 1").select(F.lit(0).alias("doc_id"), "text")
    return index.query_index(weighted, index.tokens(item).select("term_id", "f"), 50)


@query(f"""WITH {_weights_sql("lucene", "lucene")},
q0 AS (SELECT doc_id AS query, term_id, w AS qw FROM w WHERE doc_id % 50 = 0),
s AS (SELECT query, doc_id, round(sum(w * qw), 9) AS score FROM w JOIN q0 USING (term_id) GROUP BY ALL),
r AS (SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id DESC) AS INTEGER) AS rank, score, doc_id FROM s)
SELECT query, rank, score, doc_id FROM r WHERE rank <= 20""")
def bof_batched(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 documents most similar to each whose id is divisible by 50, all in one join."""
    p, docs = _postings(spark, folder)
    p = materialise(p)
    weighted = index.apply_tfidf(index.build_index(p, docs))
    return index.query_index_batched(weighted, p.filter("doc_id % 50 = 0").withColumnRenamed("doc_id", "query"), 20)


@query(f"""
WITH e AS ({_P}), n AS (SELECT q.key AS query, round({_DISTANCE_SQL['chi2'][1]}, 9) AS distance, b.key FROM e b, (SELECT * FROM e WHERE key % 50 = 0) q),
r AS (SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, key) AS INTEGER) AS rank, distance, key FROM n)
SELECT query, rank, distance, key FROM r WHERE rank <= 10""")
def knn_batched_chi2(spark: SparkSession, folder: str) -> DataFrame:
    """As knn_batched_topk, by another distance."""
    base = _vectors(spark, folder, True)
    return search.batched_search(base, base.filter("key % 50 = 0").select(F.col("key").alias("query"), "vector"), 10, "chi2")


# Quantisation of galif features by the given vocabulary.

_FEATURES = """
SELECT image_id, n - 1 AS n, CAST(features[n] AS DOUBLE[]) AS v, CAST(positions[n][1] AS DOUBLE) AS x, CAST(positions[n][2] AS DOUBLE) AS y
FROM (SELECT image_id, features, positions, unnest(range(1, len(features) + 1)) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY computed_at DESC) AS r FROM galif) WHERE r = 1)
WHERE len(features[n]) = 64 AND len(list_filter(features[n], lambda z: z IS NULL OR NOT isfinite(z))) = 0 AND len(list_filter(features[n], lambda z: z <> 0)) > 0"""

_HARD = f"""f AS ({_FEATURES}),
h AS (SELECT image_id, n, x, y, word_id FROM (SELECT image_id, n, x, y, word_id,
  row_number() OVER (PARTITION BY image_id, n ORDER BY round(list_sum(list_transform(list_zip(v, CAST(center AS DOUBLE[])), lambda t: (t[1]-t[2])*(t[1]-t[2]))), 9), word_id DESC) AS r FROM f, vocabulary) WHERE r = 1)"""


def _features(spark: SparkSession, folder: str) -> DataFrame:
    rows = latest_rows(table(spark, folder, "galif"), "image_id", "computed_at", ["features", "positions"])
    return quantise.feature_rows(rows, 64)


def _hard(spark: SparkSession, folder: str) -> DataFrame:
    return quantise.quantise_hard(_features(spark, folder), table(spark, folder, "vocabulary"), ["image_id", "n", "x", "y"])


@query(f"WITH {_HARD} SELECT image_id, CAST(n AS INTEGER) AS n, word_id FROM h")
def quantize_hard(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest word of every usable feature."""
    return _hard(spark, folder).select("image_id", "n", "word_id")


@query(f"WITH {_HARD} SELECT image_id, CAST(word_id AS BIGINT) AS bin, count(*)::DOUBLE AS f FROM h GROUP BY ALL")
def histvw_flat_hard(spark: SparkSession, folder: str) -> DataFrame:
    """Histograms of visual words of every image."""
    return quantise.histograms(_hard(spark, folder), 200)


@query(f"""WITH {_HARD}, l AS (SELECT *, unnest([0, 1, 2]) AS j FROM h),
c AS (SELECT image_id, word_id, j, CASE WHEN j = 0 THEN 0 ELSE least(floor(x * 2**j), 2**j - 1) END AS cx, CASE WHEN j = 0 THEN 0 ELSE least(floor(y * 2**j), 2**j - 1) END AS cy FROM l)
SELECT image_id, CAST((4**j - 1) / 3 * 200 + 200 * (2**j * cy + cx) + word_id AS BIGINT) AS bin, count(*)::DOUBLE AS f FROM c WHERE cx IS NOT NULL AND cy IS NOT NULL GROUP BY ALL""")
def histvw_pyramid_3(spark: SparkSession, folder: str) -> DataFrame:
    """Histograms of a spatial pyramid of three levels."""
    return quantise.histograms(_hard(spark, folder), 200, levels=3)


_SIGMA = 0.5
_FUZZY = f"""e AS ({_E}), v AS (SELECT vec_id AS word_id, CAST(embedding AS DOUBLE[]) AS c FROM embeddings WHERE vec_id < 16),
g AS (SELECT key, word_id, exp(-(list_sum(list_transform(list_zip(v, c), lambda t: (t[1]-t[2])*(t[1]-t[2]))) ** 2) / {2 * _SIGMA * _SIGMA}) AS g FROM e, v),
z AS (SELECT key, word_id, g / sum(g) OVER (PARTITION BY key) AS weight FROM g)"""


def _fuzzy(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    words = e.filter("vec_id < 16").select(F.col("vec_id").alias("word_id"), F.col("embedding").alias("center"))
    features = e.select("vec_id", "label", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("embedding").alias("feature"))
    return quantise.quantise_fuzzy(features, words, ["vec_id", "label", "x", "y"], _SIGMA)


@query(f"WITH {_FUZZY} SELECT key AS vec_id, CAST(word_id AS INTEGER) AS word_id, round(weight, 9) AS weight FROM z WHERE weight > 0")
def quantize_fuzzy(spark: SparkSession, folder: str) -> DataFrame:
    """Soft weights of every vector over the words 0 to 15."""
    return _fuzzy(spark, folder).select("vec_id", "word_id", F.round("weight", 9).alias("weight"))


@query(f"""WITH {_FUZZY}, m AS (SELECT label, word_id, weight, count(DISTINCT vec_id) OVER (PARTITION BY label) AS n FROM z JOIN embeddings ON vec_id = key)
SELECT label AS image_id, CAST(word_id AS BIGINT) AS bin, round(sum(weight / n), 9) AS f FROM m GROUP BY ALL""")
def histvw_flat_fuzzy(spark: SparkSession, folder: str) -> DataFrame:
    """Soft histograms of the vectors of each label."""
    rows = _fuzzy(spark, folder).select(F.col("label").alias("image_id"), F.col("vec_id").alias("n"), "word_id", "weight", "x", "y")
    return quantise.histograms(rows, 16, fuzzy=True).select("image_id", "bin", F.round("f", 9).alias("f"))


# Clustering: the first eight vectors are the first centers.

_KM0 = f"""e AS ({_E}), c0 AS (SELECT key AS cluster, v AS c FROM e WHERE key < 8),
a0 AS (SELECT key, v, cluster, d FROM (SELECT key, v, cluster, d, row_number() OVER (PARTITION BY key ORDER BY d, cluster) AS r FROM
  (SELECT key, v, cluster, round(list_sum(list_transform(list_zip(v, c), lambda t: (t[1]-t[2])*(t[1]-t[2]))), 9) AS d FROM e, c0)) WHERE r = 1)"""
_KM1 = f"""{_KM0}, m0 AS (SELECT cluster, i, avg(x) AS m FROM (SELECT cluster, unnest(v) AS x, unnest(range(0, 64)) AS i FROM a0) GROUP BY ALL)"""
_KM2 = f"""{_KM1}, c1 AS (SELECT cluster, list(m ORDER BY i) AS c FROM m0 GROUP BY cluster),
a1 AS (SELECT key, v, cluster, d FROM (SELECT key, v, cluster, d, row_number() OVER (PARTITION BY key ORDER BY d, cluster) AS r FROM
  (SELECT key, v, cluster, round(list_sum(list_transform(list_zip(v, c), lambda t: (t[1]-t[2])*(t[1]-t[2]))), 9) AS d FROM e, c1)) WHERE r = 1)"""


def _assigned(spark: SparkSession, folder: str, steps: int = 1) -> DataFrame:
    v = _vectors(spark, folder)
    centers = v.filter("key < 8").select(F.col("key").alias("cluster"), F.col("vector").alias("center"))
    a = kmeans.assign(v, centers)
    for _ in range(steps - 1):
        a = kmeans.assign(v, kmeans.means(a))
    return a


@query(f"WITH {_KM0} SELECT key, cluster, d FROM a0")
def kmeans_assign(spark: SparkSession, folder: str) -> DataFrame:
    return _assigned(spark, folder).select("key", "cluster", "d")


def _means(steps: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        c = kmeans.means(_assigned(spark, folder, steps))
        return c.select("cluster", F.posexplode("center").alias("i", "m")).select("cluster", F.col("i").cast("long").alias("i"), F.round("m", 9).alias("m"))

    return run


query(f"WITH {_KM1} SELECT cluster, i, round(m, 9) AS m FROM m0", "kmeans_step")(_means(1))
query(f"WITH {_KM2} SELECT cluster, i, round(avg(x), 9) AS m FROM (SELECT cluster, unnest(v) AS x, unnest(range(0, 64)) AS i FROM a1) GROUP BY ALL", "kmeans_two_steps")(_means(2))


@query(f"WITH {_KM2} SELECT count(*) AS changes FROM a0 JOIN a1 USING (key) WHERE a0.cluster <> a1.cluster")
def kmeans_changes(spark: SparkSession, folder: str) -> DataFrame:
    """How many vectors change their cluster in the second round."""
    a, b = _assigned(spark, folder).select("key", "cluster"), _assigned(spark, folder, 2).select("key", F.col("cluster").alias("now"))
    return a.join(b, "key").filter("cluster <> now").agg(F.count(F.lit(1)).alias("changes"))


@query(f"WITH {_KM0}, s AS (SELECT cluster, count(*) AS size, avg(d * d) AS variance FROM a0 GROUP BY ALL), f AS (SELECT cluster, key AS farthest FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY d DESC, key) AS r FROM a0) WHERE r = 1) SELECT cluster, size, round(variance, 9) AS variance, farthest FROM s JOIN f USING (cluster)")
def cluster_farthest(spark: SparkSession, folder: str) -> DataFrame:
    return kmeans.cluster_table(_assigned(spark, folder)).select("cluster", "size", F.round("variance", 9).alias("variance"), "farthest")


@query(f"WITH {_KM0} SELECT cluster, key FROM a0")
def cluster_members(spark: SparkSession, folder: str) -> DataFrame:
    return kmeans.members(_assigned(spark, folder))


@query(f"WITH {_KM0} SELECT round(sum(d), 6) AS potential FROM a0")
def kmeanspp_potential(spark: SparkSession, folder: str) -> DataFrame:
    v = _vectors(spark, folder)
    centers = v.filter("key < 8").select(F.col("key").alias("cluster"), F.col("vector").alias("center"))
    return kmeans.potential(v, centers).select(F.round("potential", 6).alias("potential"))


_KM3 = f"""{_KM2}, c2 AS (SELECT cluster, list(m ORDER BY i) AS c FROM (SELECT cluster, i, avg(x) AS m FROM (SELECT cluster, unnest(v) AS x, unnest(range(0, 64)) AS i FROM a1) GROUP BY ALL) GROUP BY cluster),
a2 AS (SELECT key, cluster FROM (SELECT key, cluster, row_number() OVER (PARTITION BY key ORDER BY d, cluster) AS r FROM
  (SELECT key, cluster, round(list_sum(list_transform(list_zip(v, c), lambda t: (t[1]-t[2])*(t[1]-t[2]))), 9) AS d FROM e, c2)) WHERE r = 1)"""


@query(f"WITH {_KM3} SELECT key, CAST(cluster AS INTEGER) AS cluster FROM a2")
def kmeans_three_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """The loop itself with fixed centers and three rounds."""
    v = _vectors(spark, folder)
    centers = [r.vector for r in v.filter("key < 8").orderBy("key").collect()]
    return kmeans.kmeans(v, 8, max_iterations=3, min_changes=0, centers=centers)[1]


@query()
def kmeans_full(spark: SparkSession, folder: str) -> DataFrame:
    """The whole loop; its rules are tested against a second implementation."""
    return kmeans.kmeans(_vectors(spark, folder), 16)[1]


# Samples, files, mapping, positions.


@query("SELECT image_id, rel_path, collection FROM (SELECT *, row_number() OVER (ORDER BY md5('7:' || image_id || ':' || coalesce(rel_path, '')), image_id, rel_path NULLS FIRST) AS r FROM (SELECT DISTINCT image_id, rel_path, collection FROM filelist)) WHERE r <= 100")
def sample_files(spark: SparkSession, folder: str) -> DataFrame:
    """A seeded sample of 100 different listed files."""
    files = table(spark, folder, "filelist").select("image_id", "rel_path", "collection").distinct()
    return sampling.sample_rows(files, 100, ["image_id", "rel_path"], 7)


@query(f"WITH f AS ({_FEATURES}) SELECT image_id, CAST(n AS INTEGER) AS n FROM (SELECT *, row_number() OVER (ORDER BY md5('7:' || image_id || ':' || n), image_id, n) AS r FROM f) WHERE r <= 500")
def sample_features(spark: SparkSession, folder: str) -> DataFrame:
    """A seeded sample of 500 usable features."""
    return sampling.sample_rows(_features(spark, folder).select("image_id", "n"), 500, ["image_id", "n"], 7)


@query("""
WITH f AS (SELECT image_id AS idx, rel_path AS path FROM (SELECT DISTINCT image_id, rel_path FROM filelist) WHERE image_id IS NOT NULL AND rel_path IS NOT NULL),
v AS (SELECT idx AS view_idx, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM f WHERE idx NOT IN (SELECT model_idx FROM view_model WHERE model_idx IS NOT NULL)),
m AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, min(idx) AS model_idx FROM f WHERE idx IN (SELECT model_idx FROM view_model WHERE model_idx IS NOT NULL) GROUP BY 1)
SELECT view_idx, model_idx FROM v LEFT JOIN m USING (dir)""")
def view_model_mapping(spark: SparkSession, folder: str) -> DataFrame:
    """Every listed path that is no model's, with the model of its directory."""
    files = table(spark, folder, "filelist").filter("image_id is not null").select(F.col("image_id").alias("idx"), F.col("rel_path").alias("path")).distinct()
    models = table(spark, folder, "view_model").filter("model_idx is not null").select(F.col("model_idx").alias("idx")).distinct()
    return sampling.view_model_mapping(files.join(models, "idx", "left_anti"), files.join(models, "idx", "left_semi"), strict=False)


@query(f"WITH n AS (SELECT round({_DISTANCE_SQL['l2norm'][1]}, 9) AS distance, b.key FROM ({_E}) b, (SELECT v FROM ({_E}) WHERE key = 1) q), r AS (SELECT CAST(row_number() OVER (ORDER BY distance, key) AS INTEGER) AS rank, distance, key FROM n) SELECT rank, distance, key, rel_path, '/data/' || rel_path AS filename FROM r LEFT JOIN (SELECT image_id AS key, min(rel_path) AS rel_path FROM filelist GROUP BY 1) USING (key) WHERE rank <= 25")
def results_with_filenames(spark: SparkSession, folder: str) -> DataFrame:
    """A search result with the names of the files."""
    base = _vectors(spark, folder)
    files = table(spark, folder, "filelist").groupBy("image_id").agg(F.min("rel_path").alias("rel_path"))
    return search.with_filenames(search.linear_search(base, base.filter("key = 1"), 25, "l2norm"), files, "key", "image_id", "/data")


@query("SELECT CAST(i AS INTEGER) AS n, CAST(floor((floor(i / 25) + 1) * 320 / 26) AS INTEGER) AS x, CAST(floor((i % 25 + 1) * 240 / 26) AS INTEGER) AS y FROM range(625) t(i)")
def grid_sampler(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.grid_points(spark, 320, 240, 625)


@query(f"WITH f AS ({_FEATURES}) SELECT image_id, CAST(n AS INTEGER) AS n, round(x / 2, 9) AS x, round(y / 4, 9) AS y FROM f")
def normalize_positions(spark: SparkSession, folder: str) -> DataFrame:
    rows = sampling.normalise_positions(_features(spark, folder), F.lit(2.0), F.lit(4.0))
    return rows.select("image_id", "n", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query("""
WITH r AS (SELECT image_id, features, unnest(range(1, len(features) + 1)) AS n FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY computed_at DESC) AS r FROM galif) WHERE r = 1)
SELECT image_id, CAST(n - 1 AS INTEGER) AS n FROM r WHERE features[n] IS NOT NULL AND len(list_filter(features[n], lambda z: z <> 0)) > 0""")
def filter_empty_features(spark: SparkSession, folder: str) -> DataFrame:
    """The places of the features that are not all zero."""
    rows = latest_rows(table(spark, folder, "galif"), "image_id", "computed_at", ["features"])
    flagged = rows.select("image_id", F.posexplode("features").alias("n", "v")).withColumn("empty", ~F.exists("v", lambda z: z != 0))
    return sampling.filter_empty(flagged, "empty").select("image_id", "n")


@query("""SELECT image_id, epoch_us(computed_at) AS computed_us FROM (SELECT image_id, computed_at, row_number() OVER (PARTITION BY image_id ORDER BY computed_at DESC) AS r FROM shog) WHERE r = 1""")
def newest_rows(spark: SparkSession, folder: str) -> DataFrame:
    return latest_rows(table(spark, folder, "shog"), "image_id", "computed_at", ["computed_at"]).select("image_id", F.unix_micros("computed_at").alias("computed_us"))
