"""Named tables in layers, kept in a catalog or under a base path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rows import keep_latest
from ..operators.storage import materialize

LAYERS = ("bronze", "silver", "gold", "rag")


class Layout:
    """Where the tables of each layer live.

    With ``base`` a table is a folder ``base/layer/name``; without it, a catalog table ``layer.name``, or
    ``catalog.layer.name``. Parquet is the default format; any format the session knows can be named."""

    def __init__(self, base: str | None = None, catalog: str | None = None, fmt: str = "parquet"):
        self.base, self.catalog, self.fmt = base, catalog, fmt

    def name(self, layer: str, table: str) -> str:
        parts = [self.catalog, layer, table] if self.catalog else [layer, table]
        return ".".join(parts)

    def path(self, layer: str, table: str) -> str:
        return f"{self.base.rstrip('/')}/{layer}/{table}"

    def create_schemas(self, spark: SparkSession) -> None:
        if self.base is None:
            for layer in LAYERS:
                prefix = f"{self.catalog}." if self.catalog else ""
                spark.sql(f"CREATE SCHEMA IF NOT EXISTS {prefix}{layer}")

    def read(self, spark: SparkSession, layer: str, table: str) -> DataFrame:
        if self.base is None:
            return spark.table(self.name(layer, table))
        return spark.read.format(self.fmt).load(self.path(layer, table))

    def read_stream(self, spark: SparkSession, layer: str, table: str) -> DataFrame:
        """The same table as a stream; its schema is taken from what is stored."""
        if self.base is None:
            return spark.readStream.table(self.name(layer, table))
        schema = self.read(spark, layer, table).schema
        return spark.readStream.format(self.fmt).schema(schema).load(self.path(layer, table))

    def write(self, df: DataFrame, layer: str, table: str, mode: str = "overwrite", skip_empty: bool = False,
              cluster_by: list[str] | None = None) -> bool:
        """Store a table, replacing it with its schema unless ``mode`` says otherwise. Returns whether it wrote.

        ``cluster_by`` range-partitions and sorts by those columns, so readers that filter on them skip files."""
        if skip_empty and df.isEmpty():
            return False
        if cluster_by:
            df = df.repartitionByRange(*[F.col(c) for c in cluster_by]).sortWithinPartitions(*cluster_by)
        writer = df.write.format(self.fmt).mode(mode)
        if self.fmt == "delta":
            writer = writer.option("overwriteSchema", "true")
        if self.base is None:
            writer.saveAsTable(self.name(layer, table))
        else:
            writer.save(self.path(layer, table))
        return True

    def append(self, df: DataFrame, layer: str, table: str) -> None:
        self.write(df, layer, table, mode="append")


class KeyedTable:
    """A Parquet table with at most one row per key, in folders by a hash of the key.

    A change rewrites only the folders its keys fall into. ``buckets`` is fixed when the table is made; take about one per
    128 MB that the table will hold."""

    BUCKET = "_bucket"

    def __init__(self, path: str, key: Sequence[str], buckets: int = 64):
        self.path, self.key, self.buckets = path.rstrip("/"), list(key), buckets

    def _exists(self, spark: SparkSession) -> bool:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).drop(self.BUCKET)

    def append(self, df: DataFrame, order: Sequence[str] = ()) -> int:
        """Add rows; a key that is there already gets its new row. Of several new rows of a key the newest by ``order``
        stays, then the lowest by row hash. Rows with a null in the key are refused. Returns the number of folders
        rewritten. Adding the same rows again changes nothing."""
        spark = df.sparkSession
        bad = F.raise_error(F.lit(f"null in the key {self.key}")).cast("int")
        whole = F.lit(True)
        for k in self.key:
            whole = whole & F.col(k).isNotNull()
        bucket = F.when(whole, F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")).otherwise(bad)
        new = keep_latest(df, self.key, order).withColumn(self.BUCKET, bucket)
        if self._exists(spark):
            new = materialize(new)
            # At most one number per folder.
            touched = [r[0] for r in new.select(self.BUCKET).distinct().collect()]
            old = spark.read.parquet(self.path).filter(F.col(self.BUCKET).isin(touched))
            kept = old.join(new.select(*self.key), self.key, "left_anti")
            # Stored first: folders cannot be read and replaced in one step.
            new = materialize(kept.unionByName(new, allowMissingColumns=True))
        else:
            new = materialize(new)
            touched = [r[0] for r in new.select(self.BUCKET).distinct().collect()]
        (new.repartition(self.BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(self.BUCKET).parquet(self.path))
        return len(touched)
