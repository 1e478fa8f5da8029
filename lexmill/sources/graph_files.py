"""Names of external data files inside ONNX graph files, read from the protobuf wire format."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Field numbers from the model to an initialiser's external data entries, and of key and value.
MODEL_GRAPH, GRAPH_TENSOR, TENSOR_EXTERNAL, KEY, VALUE = 7, 5, 13, 1, 2


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def fields(data: memoryview, number: int) -> Iterator[memoryview]:
    """The length-delimited fields of a number in a message, others skipped; a cut-off message ends there."""
    at = 0
    while at < len(data):
        try:
            tag, at = _varint(data, at)
            kind = tag & 7
            if kind == 2:
                size, at = _varint(data, at)
                if at + size > len(data):
                    return
                if tag >> 3 == number:
                    yield data[at : at + size]
                at += size
            elif kind == 0:
                _, at = _varint(data, at)
            elif kind in (1, 5):
                at += 8 if kind == 1 else 4
            else:
                return
        except IndexError:
            return


def external_locations(content: bytes) -> list[str]:
    out = set()
    for graph in fields(memoryview(content), MODEL_GRAPH):
        for tensor in fields(graph, GRAPH_TENSOR):
            for entry in fields(tensor, TENSOR_EXTERNAL):
                key = next(fields(entry, KEY), memoryview(b"")).tobytes()
                if key == b"location":
                    out.add(next(fields(entry, VALUE), memoryview(b"")).tobytes().decode("utf-8", "replace"))
    return sorted(out)


def external_data(spark: SparkSession, path: str) -> DataFrame:
    """path, location for each external data file that the graph files below path name; only top-level initialisers are looked at."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(p, x) for p, c in zip(batch.path, batch.content, strict=True) for x in external_locations(c)]
            yield pd.DataFrame(found, columns=["path", "location"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.onnx").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, location string")
