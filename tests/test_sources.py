"""Property files, generators on real PNGs, incremental top-k."""

import struct
import zlib
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenary import descriptors
from lumenary.operators import search
from lumenary.sources import property_file as pf
from lumenary.streaming import topk


@pytest.mark.parametrize(
    ("name", "values"),
    [
        ("std::vector<float>", [[1.5, 2.5], [], [3.0]]),
        ("std::vector<std::vector<float>>", [[[1.0], []], [], [[2.0, 3.0]]]),
        ("std::string", ["a", "", "ä/b"]),
        ("int64_t", [5, -7, 2**40]),
        ("u_int64_t", [Decimal(2**64 - 1)]),
        ("std::set<int32_t>", [[1, 2], []]),
    ],
)
def test_round_trip(spark, tmp_path, name, values):
    spark.dataSource.register(pf.PropertyFile)
    path = str(tmp_path / "x")
    assert pf.write_property_file(enumerate(values), path, name) == len(values)
    got = spark.read.format("propfile").load(path).orderBy("idx").collect()
    assert [(r.idx, r.value) for r in got] == list(enumerate(values))


def test_map_pair_gaps_and_errors(spark, tmp_path):
    spark.dataSource.register(pf.PropertyFile)
    path = str(tmp_path / "x")
    name = "std::map<std::string,std::pair<int32_t,double>>"
    pf.write_property_file(iter([(1, {"a": (1, 2.0)}), (3, {})]), path, name)
    got = spark.read.format("propfile").load(path).orderBy("idx").collect()
    assert [r.idx for r in got] == [1, 3]
    assert tuple(got[0].value["a"]) == (1, 2.0)
    with pytest.raises(Exception, match="holds elements of type"):
        spark.read.format("propfile").option("type", "float").load(path).collect()
    with pytest.raises(ValueError, match="unknown type"):
        pf.parse("std::list<float>")
    with pytest.raises(ValueError, match="ascending"):
        pf.write_property_file(iter([(1, 1), (1, 2)]), path, "int32_t")


def png(path, rows):
    h, w = len(rows), len(rows[0])
    raw = b"".join(b"\0" + bytes(v for p in r for v in p) for r in rows)

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_tinyimage(spark, tmp_path):
    png(tmp_path / "a.png", [[(255, 0, 0), (0, 255, 0)], [(0, 0, 255), (255, 255, 255)]])
    (tmp_path / "b.png").write_bytes(b"no image")
    images = spark.read.format("image").load(str(tmp_path)).withColumn("image_id", F.when(F.col("image.origin").endswith("a.png"), 0).otherwise(1))
    got = {r.image_id: r.features for r in descriptors.compute_descriptors(images, "tinyimage", width=2, height=2, colorspace="rgb").collect()}
    assert got == {0: [0, 0, 1, 0, 1, 0, 1, 0, 0, 1, 1, 1], 1: None}
    one = {r.image_id: r.features for r in descriptors.compute_descriptors(images, "tinyimage", width=1, height=1, colorspace="grey").collect()}
    assert one[0] == pytest.approx([0.5])
    with pytest.raises(ValueError, match="unknown generator"):
        descriptors.create("tensor")


def test_area_resize_weighs_fractions():
    m = np.array([[[1.0], [2.0], [4.0]]])
    assert descriptors.area_resize(m, 2, 1).ravel().tolist() == pytest.approx([(1 + 0.5 * 2) / 1.5, (0.5 * 2 + 4) / 1.5])


def test_stream_equals_one_search(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)], "key long, vector array<double>")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    q = rows.filter("key = 0")
    for part in range(3):
        rows.filter(F.col("key") % 3 == part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    run = topk.incremental_topk(stream, q, 7, "l2norm", out, str(tmp_path / "check"))
    assert run.awaitTermination(120)
    want = search.linear_search(rows, q, 7, "l2norm").collect()
    assert sorted(topk.current(run, rows, out).collect()) == sorted(want)


def test_property_files_written_by_spark(spark, tmp_path):
    spark.dataSource.register(pf.PropertyFile)
    path = str(tmp_path / "out.prop")
    rows = [(i, [float(i), i / 2]) for i in range(40) if i % 7]
    df = spark.createDataFrame(rows, "idx long, value array<float>").repartition(5)
    df.write.format("propfile").option("type", "std::vector<float>").mode("overwrite").save(path)
    assert sorted((r.idx, r.value) for r in spark.read.format("propfile").load(path).collect()) == rows
    assert [p.name for p in tmp_path.iterdir()] == ["out.prop"]
    twice = df.unionByName(df)
    with pytest.raises(Exception, match="twice"):
        twice.write.format("propfile").option("type", "std::vector<float>").mode("overwrite").save(path)


def test_a_partition_reads_its_own_offsets(spark, tmp_path, monkeypatch):

    path = str(tmp_path / "x.prop")
    pf.write_property_file(iter([(i, [float(i)]) for i in range(0, 25, 2)]), path, "std::vector<float>")
    monkeypatch.setattr(pf, "PART", 4)
    reader = pf._Reader(path, None)
    parts = reader.partitions()
    assert [(p.start, p.count) for p in parts] == [(0, 4), (4, 4), (8, 4), (12, 4), (16, 4), (20, 4), (24, 1)]
    assert [x for p in parts for x in reader.read(p)] == [(i, [float(i)]) for i in range(0, 25, 2)]
