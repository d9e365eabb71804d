"""Command line: python -m lumenary.cli COMMAND ... ; tables are Parquet folders.

Commands build the offline pipeline step by step (files, mapping, descriptors, vocabulary, histograms, index) and search it.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenary import descriptors
from lumenary.operators import index, kmeans, quantise, sampling, search


def pairs(given: list[str]) -> dict[str, object]:
    """k=v arguments; numbers are read as numbers, a lone k is true."""
    out: dict[str, object] = {}
    for g in given:
        k, _, v = g.partition("=")
        try:
            out[k] = json.loads(v) if v else True
        except json.JSONDecodeError:
            out[k] = v
    return out


def generate_filelist(spark: SparkSession, a: argparse.Namespace) -> None:
    files = sampling.list_files(spark, a.root, a.glob)
    if a.sample is not None:
        files = sampling.sample_rows(files, a.sample, ["rel_path"], a.seed).select("rel_path")
        files = sampling.ordinal(files, "rel_path", "image_id")
    files.write.mode("overwrite").parquet(a.output)


def generate_mapping(spark: SparkSession, a: argparse.Namespace) -> None:
    views, models = (spark.read.parquet(p).select(F.col("image_id").alias("idx"), F.col("rel_path").alias("path")) for p in (a.views, a.models))
    sampling.view_model_mapping(views, models).write.mode("overwrite").parquet(a.output)


def compute_descriptors(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.action == "list":
        print("\n".join(sorted(descriptors.GENERATORS)))
        return
    name, parameters = descriptors.read_parameters(a.parameters) if a.parameters else (None, {})
    name, parameters = a.generator or name or "tinyimage", parameters | pairs(a.parameter)
    effective = descriptors.parameters_json(name, descriptors.create(name, **parameters))
    if a.action == "info":
        print(effective)
        return
    images = spark.read.format("image").option("recursiveFileLookup", "true").load(a.root)
    images = images.withColumn("rel_path", F.substring_index("image.origin", a.root.rstrip("/") + "/", -1))
    keyed = images.join(spark.read.parquet(a.files).select("image_id", "rel_path"), "rel_path")
    descriptors.compute_descriptors(keyed, name, **parameters).write.mode("overwrite").parquet(a.output)
    # beside the data: one line of JSON with all parameters, those by default too
    spark.createDataFrame([(effective,)], "value string").coalesce(1).write.mode("overwrite").text(a.output.rstrip("/") + ".parameters")


def local_rows(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    rows = rows if "positions" in rows.columns else rows.withColumn("positions", F.lit(None).cast("array<array<float>>"))
    first = rows.filter("size(features) > 0").select(F.size(F.get("features", F.lit(0)))).first()
    return quantise.feature_rows(rows, first[0] if first else 0)


def compute_vocabulary(spark: SparkSession, a: argparse.Namespace) -> None:
    features = local_rows(spark, a.descriptors).select(F.concat_ws(":", "image_id", "n").alias("key"), F.col("feature").alias("vector"))
    ids = features.select(F.xxhash64("key").alias("key"), "vector")
    words = kmeans.compute_vocabulary(ids, a.clusters, a.samples, a.seed, max_iterations=a.max_iterations, min_changes=a.min_changes, distance=a.distance, init=a.init)
    words.write.mode("overwrite").parquet(a.output)


def compute_histvw(spark: SparkSession, a: argparse.Namespace) -> None:
    words = spark.read.parquet(a.vocabulary)
    keys, features = ["image_id", "n", "x", "y"], local_rows(spark, a.descriptors)
    if a.quantization == "fuzzy":
        if a.sigma is None:
            raise SystemExit("--sigma is needed for fuzzy quantization")
        rows = quantise.quantise_fuzzy(features, words, keys, a.sigma)
    else:
        rows = quantise.quantise_hard(features, words, keys)
    quantise.histograms(rows, words.count(), a.levels, a.quantization == "fuzzy").write.mode("overwrite").parquet(a.output)


def compute_index(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = spark.read.parquet(a.histograms).select(F.col("image_id").alias("doc_id"), F.col("bin").alias("term_id"), "f")
    docs = spark.read.parquet(a.files).select(F.col("image_id").alias("doc_id")) if a.files else rows.select("doc_id")
    index.apply_tfidf(index.build_index(rows, docs), *a.tfidf).save(a.output)


def query_features(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The row of features (and positions) of the image file given as query."""
    name, parameters = descriptors.read_parameters(a.parameters) if a.parameters else (None, {})
    images = spark.read.format("image").load(a.query_image).withColumn("image_id", F.lit(0).cast("long"))
    return descriptors.compute_descriptors(images, a.generator or name or "tinyimage", **(parameters | pairs(a.parameter)))


def image_search(spark: SparkSession, a: argparse.Namespace) -> None:
    if (a.image is None) == (a.query_image is None):
        raise SystemExit("one of --image and --query-image is needed")
    if a.query_image is None and a.query is None:
        raise SystemExit("--image needs --query")
    if a.index:
        ix = index.InvertedIndex.load(spark, a.index)
        if a.query_image is not None:
            if a.vocabulary is None:
                raise SystemExit("a query image needs --vocabulary to be searched in an index")
            words = spark.read.parquet(a.vocabulary)
            dim = words.select(F.size("center")).first()[0]
            rows = quantise.feature_rows(query_features(spark, a), dim)
            bins = quantise.histograms(quantise.quantise_hard(rows, words, ["image_id", "n", "x", "y"]), words.count(), a.levels)
        else:
            bins = spark.read.parquet(a.query).filter(F.col("image_id") == a.image)
        found = index.query_index(ix, bins.select(F.col("bin").alias("term_id"), "f"), a.k, *a.tfidf).withColumnRenamed("doc_id", "key")
    else:
        if a.query is None:
            raise SystemExit("a search without an index needs --query, the table of features")
        base = spark.read.parquet(a.query).select(F.col("image_id").alias("key"), F.col("features").alias("vector"))
        one = query_features(spark, a).select(F.col("features").alias("vector")) if a.query_image is not None else base.filter(F.col("key") == a.image)
        found = search.linear_search(base, one, a.k, a.distance)
    if a.files:
        one = spark.read.parquet(a.files).withColumn("_r", F.row_number().over(Window.partitionBy("image_id").orderBy("rel_path"))).filter("_r = 1")
        found = search.with_filenames(found, one, "key", "image_id")
    for r in found.orderBy("rank").toLocalIterator():
        print(r["rank"], r["score" if a.index else "distance"], r["key"], *([r["rel_path"]] if a.files else []))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lumenary", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)

    def command(f: object, *names: str, **options: dict) -> None:
        c = commands.add_parser(f.__name__)
        c.set_defaults(run=f)
        for n in names:
            c.add_argument(f"--{n}", required=True)
        for n, o in options.items():
            c.add_argument(f"--{n.replace('_', '-')}", **o)

    number, real, names = {"type": int}, {"type": float}, {"nargs": 2, "default": ["lucene", "lucene"], "metavar": ("TF", "IDF")}
    command(generate_filelist, "root", "output", glob={"action": "append"}, sample=number, seed=number | {"default": 0})
    command(generate_mapping, "views", "models", "output")
    command(compute_descriptors, action={"choices": ["compute", "info", "list"], "default": "compute"}, generator={}, parameters={"metavar": "JSON"}, root={}, files={}, output={}, parameter={"action": "append", "default": [], "metavar": "K=V"})
    command(compute_vocabulary, "descriptors", "output", clusters=number | {"required": True}, samples=number, seed=number | {"default": 0}, max_iterations=number | {"default": 20}, min_changes=real | {"default": 0.01}, distance={"default": "l2norm_squared"}, init={"choices": ["random", "plusplus"], "default": "random"})
    command(compute_histvw, "descriptors", "vocabulary", "output", quantization={"choices": ["hard", "fuzzy"], "default": "hard"}, sigma=real, levels=number | {"default": 1})
    command(compute_index, "histograms", "output", files={}, tfidf=names)
    image = {"query_image": {}, "generator": {}, "parameters": {"metavar": "JSON"}, "parameter": {"action": "append", "default": [], "metavar": "K=V"}, "vocabulary": {}, "levels": number | {"default": 1}}
    command(image_search, query={}, image=number, **image, index={}, files={}, k=number | {"default": 20}, distance={"default": "l2norm"}, tfidf=names)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lumenary").getOrCreate()
    a.run(spark, a)


if __name__ == "__main__":
    main()
