"""Language identification over a stream, with a model trained in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.operators import detect


def detect_stream(spark: SparkSession, stream: DataFrame, priors: DataFrame, features: DataFrame, sink: str, checkpoint: str, available_now: bool = True):
    """Writes doc_id, predicted, score of each document of the stream (doc_id, text) to a Parquet sink; gives the query.

    Each micro-batch is the batch operator; a batch is written below its own number, so a
    batch that runs again replaces its rows instead of adding to them.
    """
    model = detect.packed(priors, features)

    def write(batch: DataFrame, number: int) -> None:
        detect.predict(detect.scores(batch, *model)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = stream.select("doc_id", "text").writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
