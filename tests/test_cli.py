"""The whole pipeline by commands: histograms, index and search find an image by itself."""

import numpy as np
import pytest

from lumenary import cli


def test_pipeline(spark, tmp_path, capsys):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=(6, 4)).tolist(), rng.random((6, 2)).tolist()) for i in range(12)] + [(12, None, None)]
    at = lambda name: str(tmp_path / name)
    spark.createDataFrame(rows, "image_id long, features array<array<float>>, positions array<array<float>>").write.parquet(at("local"))
    spark.createDataFrame([(i, f"d{i}/x.png") for i in range(13)], "image_id long, rel_path string").write.parquet(at("files"))
    cli.main(["compute_vocabulary", "--descriptors", at("local"), "--output", at("words"), "--clusters", "5", "--samples", "40"])
    for q in (["hard"], ["fuzzy", "--sigma", "1.0"]):
        cli.main(["compute_histvw", "--descriptors", at("local"), "--vocabulary", at("words"), "--output", at("hist"), "--levels", "2", "--quantization", *q])
        cli.main(["compute_index", "--histograms", at("hist"), "--files", at("files"), "--output", at("index")])
        capsys.readouterr()
        cli.main(["image_search", "--query", at("hist"), "--image", "3", "--index", at("index"), "--files", at("files"), "--k", "13"])
        lines = capsys.readouterr().out.splitlines()
        assert len(lines) == 13
        assert lines[0].split() == ["1", "1.0", "3", "d3/x.png"]
        assert lines[-1].split()[1] == "0.0"


def test_mapping_and_lists(spark, tmp_path, capsys):
    for name in ("v/a/1.png", "v/b/2.png", "m/a/1.off", "m/b/2.off"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    for side in "vm":
        cli.main(["generate_filelist", "--root", str(tmp_path / side), "--output", str(tmp_path / f"list_{side}")])
    cli.main(["generate_mapping", "--views", str(tmp_path / "list_v"), "--models", str(tmp_path / "list_m"), "--output", str(tmp_path / "map")])
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "map")).collect())) == [(0, 0), (1, 1)]
    capsys.readouterr()
    cli.main(["compute_descriptors", "--action", "info", "--parameter", "width=8"])
    assert '"width": 8' in capsys.readouterr().out
    assert cli.pairs(["a=1", "b", "c=x"]) == {"a": 1, "b": True, "c": "x"}
    with pytest.raises(SystemExit):
        cli.main(["compute_index"])


def png(path, m):
    import struct
    import zlib

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + row.tobytes() for row in m)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", m.shape[1], m.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.mark.parametrize("indexed", [False, True])
def test_a_query_image_finds_itself(spark, tmp_path, capsys, indexed):
    at = lambda name: str(tmp_path / name)
    (tmp_path / "im").mkdir()
    for i in range(5):
        m = np.full((48, 48, 3), 255, np.uint8)
        m[8 + 6 * i : 11 + 6 * i, 5:40] = 0
        m[5:40, 40 - 7 * i : 42 - 7 * i] = 0
        png(tmp_path / "im" / f"{i}.png", m)
    cli.main(["generate_filelist", "--root", at("im"), "--output", at("files")])
    (tmp_path / "p.json").write_text('{"generator": {"name": "galif", "image_width": 48, "sampler": {"name": "grid", "num_samples": 36}}}' if indexed else '{"generator": {"name": "tinyimage", "width": 12}}')
    cli.main(["compute_descriptors", "--parameters", at("p.json"), "--root", at("im"), "--files", at("files"), "--output", at("d")])
    assert '"num_orients": 4' in spark.read.text(at("d.parameters")).first()[0] or not indexed
    search = ["image_search", "--query-image", at("im/3.png"), "--parameters", at("p.json"), "--files", at("files"), "--k", "5"]
    if indexed:
        cli.main(["compute_vocabulary", "--descriptors", at("d"), "--output", at("words"), "--clusters", "8", "--init", "plusplus"])
        cli.main(["compute_histvw", "--descriptors", at("d"), "--vocabulary", at("words"), "--output", at("hist"), "--levels", "2"])
        cli.main(["compute_index", "--histograms", at("hist"), "--files", at("files"), "--output", at("index")])
        search += ["--index", at("index"), "--vocabulary", at("words"), "--levels", "2"]
    else:
        search += ["--query", at("d")]
    capsys.readouterr()
    cli.main(search)
    lines = capsys.readouterr().out.splitlines()
    assert len(lines) == 5
    assert lines[0].split()[3] == "3.png"
    with pytest.raises(SystemExit):
        cli.main(["image_search", "--query", at("d")])
