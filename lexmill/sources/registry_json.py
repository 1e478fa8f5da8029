"""Model registries as JSON: one object per file, from model id to entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LID_ENTRY = "engine string, hf_repo string, license string, loss string, model_id string, num_labels int, onnx_file string, precision string, side_files map<string,string>, size_mb long, notes string"


def read_registry(spark: SparkSession, path: str, entry: str = LID_ENTRY) -> DataFrame:
    """A row per model with the declared fields; other fields are left in the column `rest` as JSON text by name.

    Works on whole registry files, of which there are few; each is one row until it is exploded.
    """
    whole = spark.read.text(path, wholetext=True)
    models = whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "entry"))
    parsed = models.select("key", F.from_json("entry", entry).alias("e"), F.from_json("entry", "map<string,string>").alias("all"))
    names = [c.strip().split(" ")[0] for c in _top_level(entry)]
    rest = F.map_filter("all", lambda k, _: ~k.isin(*names))
    fields = [F.coalesce("e.model_id", "key").alias("model_id") if n == "model_id" else F.col(f"e.{n}").alias(n) for n in names]
    return parsed.select(*fields, rest.alias("rest"))


def _top_level(ddl: str) -> list[str]:
    out, depth, word = [], 0, ""
    for c in ddl:
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            out.append(word)
            word = ""
        else:
            word += c
    return [*out, word]


def point_lookup(registry: DataFrame, model_id: str) -> DataFrame:
    """The row of one model; an unknown id is an error that lists some of the known ones."""
    found = registry.where(F.col("model_id") == model_id)
    if found.isEmpty():
        known = [r["model_id"] for r in registry.select("model_id").orderBy("model_id").limit(20).collect()]
        raise ValueError(f"unknown model {model_id!r}; known: {', '.join(known)}")
    return found


def write_registry(entries: DataFrame, path: str) -> None:
    """One JSON line per model, by id, fields by name, so equal registries give equal bytes."""
    columns = sorted(c for c in entries.columns)
    entries.select(*columns).orderBy("model_id").coalesce(1).write.mode("overwrite").json(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """label_idx, raw of labels.json, a JSON list in label order."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", "array<string>")).alias("label_idx", "raw"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """word_id, word of vocab.txt, one word per line; a line break at the end adds none."""
    whole = spark.read.text(path, wholetext=True)
    words = F.split(F.regexp_replace("value", "\n\\z", ""), "\n", -1)
    return whole.select(F.posexplode(words).alias("word_id", "word"))


def read_huffman_tree(spark: SparkSession, path: str) -> DataFrame:
    """label_idx, node, bit of hs_tree.json; paths and codes of different lengths are an error."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "paths array<array<int>>, codes array<array<boolean>>").alias("t"))
    rows = whole.select(F.posexplode(F.arrays_zip("t.paths", "t.codes")).alias("label_idx", "z"))
    same = F.assert_true(F.size("z.paths") == F.size("z.codes"), F.lit("a path and its code differ in length"))
    steps = rows.select("label_idx", F.explode(F.arrays_zip("z.paths", "z.codes")).alias("s"), same.alias("ok"))
    return steps.select("label_idx", F.col("s.paths").alias("node"), F.col("s.codes").alias("bit"))
