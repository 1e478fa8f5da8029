import json

from pyspark.sql import functions as F

from lexmill.operators import detect
from lexmill.sources.fences import code_fences
from lexmill.sources.graph_files import external_data, external_locations
from lexmill.sources.registry_json import point_lookup, read_huffman_tree, read_labels, read_registry, read_vocabulary, write_registry
from lexmill.streaming.detect import detect_stream


def message(*parts):
    """A protobuf message of length-delimited fields and, for integers, varints."""
    out = b""
    for number, value in parts:
        if isinstance(value, int):
            out += bytes([number << 3]) + bytes([value])
        else:
            size = len(value)
            out += bytes([number << 3 | 2]) + (bytes([size]) if size < 128 else bytes([size & 127 | 128, size >> 7])) + value
    return out


def graph(*names):
    tensors = [(5, message((1, 3), (13, message((1, b"location"), (2, n.encode()))), (13, message((1, b"offset"), (2, b"0"))))) for n in names]
    return message((1, 8), (7, message((2, b"g"), *tensors)))


def test_external_data(spark, tmp_path):
    (tmp_path / "a.onnx").write_bytes(graph("a.data", "b.data", "a.data"))
    (tmp_path / "plain.onnx").write_bytes(graph())
    (tmp_path / "other.txt").write_bytes(b"x")
    assert sorted(r.location for r in external_data(spark, str(tmp_path)).collect()) == ["a.data", "b.data"]
    assert external_locations(graph("x" * 150)[:40]) == []


def test_registry_round_trip(spark, tmp_path):
    entries = {"b": {"engine": "fasttext", "size_mb": 3, "side_files": {"vocab": "v"}, "own": {"x": 1}}, "a": {"engine": "hf", "num_labels": 2}}
    (tmp_path / "r.json").write_text(json.dumps(entries, indent=1))
    registry = read_registry(spark, str(tmp_path / "r.json"))
    rows = {r.model_id: r for r in registry.collect()}
    assert rows["b"].size_mb == 3 and rows["b"].side_files == {"vocab": "v"} and rows["b"].rest == {"own": '{"x":1}'} and rows["a"].size_mb is None
    assert point_lookup(registry, "a").count() == 1
    try:
        point_lookup(registry, "zz")
        raise AssertionError
    except ValueError as error:
        assert "a, b" in str(error)
    write_registry(registry, str(tmp_path / "out"))
    (part,) = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("part")]
    assert [json.loads(line)["model_id"] for line in part.read_text().splitlines()] == ["a", "b"]


def test_side_files(spark, tmp_path):
    (tmp_path / "labels.json").write_text('["__label__en", "__label__pt"]')
    (tmp_path / "vocab.txt").write_text("the\nof\n\nend\n")
    (tmp_path / "hs_tree.json").write_text('{"paths": [[1], [0, 1]], "codes": [[false], [true, true]]}')
    assert [tuple(r) for r in read_labels(spark, str(tmp_path / "labels.json")).collect()] == [(0, "__label__en"), (1, "__label__pt")]
    assert [tuple(r) for r in read_vocabulary(spark, str(tmp_path / "vocab.txt")).collect()] == [(0, "the"), (1, "of"), (2, ""), (3, "end")]
    assert sorted(tuple(r) for r in read_huffman_tree(spark, str(tmp_path / "hs_tree.json")).collect()) == [(0, 1, False), (1, 0, True), (1, 1, True)]


def test_fences(spark, tmp_path):
    (tmp_path / "d.md").write_text("x\n```python\na = 1\n```\n<!-- skip -->\n```python\nb\n```\n```sh\nls\n```\n")
    assert [(r.pos, r.code, r.directive) for r in code_fences(spark, str(tmp_path / "d.md")).collect()] == [(0, "a = 1\n", "none"), (1, "b\n", "skip")]


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    training = detect.is_training(F.col("text"))
    priors, features = (x.cache() for x in detect.train(docs.where(training)))
    held = docs.where(~training)
    held.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(held.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = detect_stream(spark, stream, priors, features, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    got = sorted((r.doc_id, r.predicted, r.score) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(tuple(r) for r in detect.predict(detect.scores(held, *detect.packed(priors, features))).collect())
