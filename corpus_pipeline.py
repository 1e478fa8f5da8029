"""The corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, packing.

Each stage takes the rows that its predecessor kept, as (spark, docs, sf_dir); all but the
last give the columns of `documents` back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.cluster import scratch, tasks_for, text_bytes
from lexmill.llm.mixing import poisson_mix, shuffled
from lexmill.llm.near_dedup import near_duplicate_groups
from lexmill.llm.packing import pack_documents
from lexmill.llm.quality import quality_cascade
from lexmill.llm.substring_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule turns away; null and empty texts go.

    Rows without doc_id and repeated rows are judged like any other. An empty table gives no rows.
    """
    judged = quality_cascade(docs, carry=("doc_id", "lang", "source", "n_chars"), with_text=True)
    return judged.where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates; rows that share an id stay together.

    Links start at a similarity of 0.80. With 40 bands of 6 coordinates a pair exactly there
    escapes every band with probability (1 - 0.8**6)**40 = 5e-6.
    """
    kept = near_duplicate_groups(docs, percent=80, bands=40, rows=6).where("kept and doc_id is not null").select("doc_id").distinct()
    nameless = docs.where("doc_id is null")
    return docs.join(kept, "doc_id", "left_semi").select(*COLUMNS).union(nameless.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 13-word passages that a smaller id has too; those with nothing left go.

    Rows without doc_id keep all and take nothing from others; rows of one id take nothing
    from each other. An empty table gives no rows.
    """
    return remove_repeats(docs, carry=("lang", "source")).where("kept_text <> ''").select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by the Poisson counts of their sources' target rates, in a global random order.

    Null doc_id, text or source are values like any other, empty texts count as documents,
    repeated rows get the same number of copies. An empty table gives no rows. Columns
    beyond those of documents are dropped.
    """
    mixed = poisson_mix(docs.select(*COLUMNS))
    return shuffled(mixed, tasks_for(2 * text_bytes(docs)[1], 24 << 20, spark)).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all token pieces in sequences of 1024.

    Null and empty texts are the end id alone; rows with a null doc_id and repeated rows are
    packed like any other, once each. An empty table gives no rows.
    """
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing), ("packing", packing)]

#: tokenizers and sketches have no SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again.

    Nulls, empty texts and repeated rows fare as each stage states: null and empty texts go
    with the first stage, rows without doc_id pass all of them, columns beyond those of
    documents are dropped. An empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
