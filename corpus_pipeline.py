"""A corpus pipeline: each stage is one operator of tidemark.llm, written as Parquet and read again by the next.

For all stages: other columns of the documents pass through, whatever their
names; null text counts as empty; a null id is an id like any other unless a
stage says otherwise; texts of any length are read whole; an empty table gives
an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import quality_crf
from tidemark.llm.base import scratch, table
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.packing import pack
from tidemark.llm.simhash import near_texts


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id and text of each document, and all its columns as one, so that no name clashes."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier doesn't reject (score below the threshold).

    Repeated rows and equal texts get one verdict. Without usable labels every score is 0.5 and all stay.
    """
    model = quality_crf.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality_crf.score(_rows(docs), model, score_col="score").where(F.col("score") >= quality_crf.THRESHOLD).select("row.*")


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of largest doc_id of those with the same text.

    A null id ranks lowest. Of rows equal in id and text one stays.
    """
    found = exact_dedup(docs.select("doc_id", "text"))
    kept = found.where("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"), (F.col("group_size") > 1).alias("several"))
    rows = _rows(docs).withColumn("own", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    out = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("sha")))
    # rows equal in id and text are one document: only groups that had several rows are looked at again
    once = out.where("not several").select("row")
    again = out.where("several").dropDuplicates(["id", "sha"]).select("row")
    return once.unionByName(again).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each group of near duplicates (0.8 of all five-word shingles or more are common).

    Texts without words are alike. A document without id stays. Rows equal in id stay or go together.
    """
    found = near_texts(docs.select("doc_id", "text"))
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct()
    return _rows(docs).join(gone, F.col("doc_id") == F.col("id"), "left_anti").select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources come near their targets.

    A null source is a source, and one without words has target 0. Rows equal in id share a decision.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences.

    A document that mixing repeated is packed as often. An empty text is its end token.
    """
    return pack(docs.select("doc_id", "text"))


STAGES = [("quality", quality), ("exact_dedup", dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Scores of a fitted classifier, shared shingles and a vocabulary are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over `documents`."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
