"""A training-data pipeline: stages over ``documents``, each written and read again as the next one's input.

Toxic texts go, one text of each group of near-duplicates stays, repeated passages are cut, texts that hold benchmark
passages go, and what is left is packed into sequences. All stages but the last return the columns of ``documents``;
other columns of the input are dropped. No stage is expressible in SQL as a whole, so ORACLE_SQL is None and
``tests/llm`` compares the pipeline with a brute-force version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltlane.llm import text as tx
from voltlane.llm.decontaminate import contamination
from voltlane.llm.near_duplicates import near_duplicates
from voltlane.llm.packing import pack
from voltlane.llm.substrings import substring_dedup
from voltlane.llm.toxicity import ToxicityModel, learning_rows
from voltlane.operators.storage import materialize

#: Documents with this score or more go.
TOXIC = 0.3
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic. The model learns from the labelled rows of its own input; without toxic or
    without clean ones among them all documents stay."""
    docs = docs.select(*COLUMNS)
    model = ToxicityModel(learning_rows(docs, tx.read(spark, sf_dir, "labels")), docs=docs)
    return docs.filter(model.rating() < TOXIC)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; of repeated ids one row. Rows without id stay."""
    docs = docs.select(*COLUMNS)
    kept = near_duplicates(docs).filter("kept").select("doc_id").filter("doc_id is not null").distinct()
    once = Window.partitionBy("doc_id").orderBy(F.xxhash64(*COLUMNS))
    one = (docs.join(kept, "doc_id", "left_semi").withColumn("_n", F.row_number().over(once)).filter("_n = 1").select(*COLUMNS))
    return one.unionByName(docs.filter("doc_id is null"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one (or an earlier place) has."""
    cut = substring_dedup(docs.select(*COLUMNS), carry=COLUMNS[2:])
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("bigint")).otherwise(F.col("n_chars"))
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    found = contamination(docs, tx.read(spark, sf_dir, "benchmark"), carry=COLUMNS)
    return found.filter(F.size("spans") == 0).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity), ("minhash_near_dedup", near_dedup), ("substring_dedup", substrings),
    ("benchmark_decontamination", decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table ``documents``."""
    docs = tx.read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
