"""Sinks that may see a micro-batch twice: each batch owns a folder named by its id and writes it anew.

A query that stops after writing a batch and before remembering that it did so gets the same batch again under the same
id when it is started again. Everything here is overwritten then, so a run with stops leaves what a run without leaves."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.quality import expect_all_or_drop
from ..plans import feeds
from .flows import AVAILABLE_NOW


def _each(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, trigger: str, mode: str = "append") -> StreamingQuery:
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if trigger == AVAILABLE_NOW else writer.trigger(processingTime=trigger)).start()


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Ids of the batch folders under a path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def start(df: DataFrame, out: str, checkpoint: str, trigger: str = AVAILABLE_NOW, mode: str = "append") -> StreamingQuery:
    """Append a stream to ``out``, a folder per batch; read it with ``read``."""
    return _each(df, lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}"), checkpoint, trigger, mode)


def read(spark: SparkSession, out: str) -> DataFrame:
    """What all batches wrote."""
    return spark.read.parquet(out).drop("batch")


# --- rule counts ------------------------------------------------------------------------------------------------------

def start_checked(df: DataFrame, rules: Mapping[str, str], out: str, counts: str, checkpoint: str,
                  trigger: str = AVAILABLE_NOW) -> StreamingQuery:
    """Keep the rows for which every rule is true, and write how many each rule passed and dropped in each batch. The
    counts are observed while the batch is written, not in a pass of their own."""
    def write(batch: DataFrame, i: int) -> None:
        seen = Observation()
        expect_all_or_drop(batch, rules, seen).write.mode("overwrite").parquet(f"{out}/batch={i}")
        found = seen.get
        rows = [(rule, found[f"{rule}_passed"], found[f"{rule}_dropped"]) for rule in rules]
        batch.sparkSession.createDataFrame(rows, "rule string, passed bigint, dropped bigint").coalesce(1).write.mode("overwrite").parquet(f"{counts}/batch={i}")

    return _each(df, write, checkpoint, trigger)


def rule_counts(spark: SparkSession, counts: str) -> DataFrame:
    """rule, passed, dropped over all batches: what ``expectation_report`` says of all rows at once."""
    return spark.read.parquet(counts).groupBy("rule").agg(F.sum("passed").alias("passed"), F.sum("dropped").alias("dropped"))


# --- gold over streamed silver -----------------------------------------------------------------------------------------

def start_regional(stations: DataFrame, out: str, checkpoint: str, trigger: str = AVAILABLE_NOW) -> StreamingQuery:
    """Fold a stream of cleaned stations, each id once (see ``flows.silver_stations_stream``), into totals per region.

    A batch adds its own totals to those up to the batch before it and writes the sum under its id: work follows the
    batch, not the table, and a repeated batch starts from the same totals again. Only the last two are kept."""
    def fold(batch: DataFrame, i: int) -> None:
        spark = batch.sparkSession
        parts = feeds.regional_parts(batch)
        known = _batches(spark, out)
        before = [b for b in known if b < i]
        if before:
            parts = feeds.merge_regional(spark.read.parquet(f"{out}/batch={before[-1]}").unionByName(parts))
        parts.coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={i}")
        for b in before[:-1]:
            _remove(spark, f"{out}/batch={b}")

    return _each(stations, fold, checkpoint, trigger)


def read_regional(spark: SparkSession, out: str, as_of=None) -> DataFrame:
    """``feeds.feed_regional`` of everything folded so far."""
    return feeds.regional_measures(spark.read.parquet(f"{out}/batch={_batches(spark, out)[-1]}"), as_of)
