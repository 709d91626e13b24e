"""Landed JSON lines under a schema that is remembered from start to start.

The first start takes the schema from what has landed, with the types of the hints, and stores it; later starts use the
stored one, so the columns of a table do not change under its readers. What the schema does not know is kept: unknown
fields in one column, lines that do not parse in another, and the file of every row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.shape import apply_hints

RESCUED, CORRUPT = "_rescued_data", "_corrupt_record"


def stored_schema(spark: SparkSession, store: str) -> T.StructType | None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return T._parse_datatype_json_string(spark.read.text(store, wholetext=True).head()[0])


def store_schema(spark: SparkSession, store: str, schema: T.StructType) -> None:
    spark.createDataFrame([(schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(store)


def remembered_schema(spark: SparkSession, src: str, store: str, hints: str | None = None, add: str | None = None) -> T.StructType:
    """The schema of a landing folder. ``store`` is a folder beside the checkpoint. ``hints`` force the types of columns and
    add missing ones, at the first start; ``add`` names fields to take up from now on, such as ones seen in RESCUED."""
    schema = stored_schema(spark, store)
    if schema is None:
        found = spark.read.option("columnNameOfCorruptRecord", CORRUPT).json(src).schema
        schema = T.StructType([f for f in found.fields if f.name != CORRUPT])
        schema = apply_hints(schema, hints) if hints else schema
        store_schema(spark, store, schema)
    if add:
        new = [f for f in T.StructType.fromDDL(add).fields if f.name not in schema.fieldNames()]
        schema = T.StructType(schema.fields + new)
        store_schema(spark, store, schema)
    return schema


def landed(spark: SparkSession, src: str, schema: T.StructType, max_files: int = 1000) -> DataFrame:
    """Stream of landed lines: the columns of the schema, RESCUED (JSON text of the other fields, or null), CORRUPT (the
    line if it does not parse or a value does not fit its type, or null) and ``source_file``. Blank lines are left out.
    Each line is read once; no field is lost."""
    lines = (spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(src)
             .select("value", F.col("_metadata.file_path").alias("source_file")).filter(F.trim("value") != ""))
    return parse_lines(lines, schema)


def parse_lines(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """The same for a frame of ``value`` and ``source_file``."""
    whole = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    record = F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    fields = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
    other = F.map_filter(fields, lambda k, _: ~k.isin(schema.fieldNames()))
    rows = lines.select(record.alias("_r"), other.alias("_o"), "source_file")
    rescued = F.when(F.col(f"_r.{CORRUPT}").isNull() & (F.size("_o") > 0), F.to_json("_o"))
    return rows.select(*[F.col(f"_r.`{n}`") for n in schema.fieldNames()], rescued.alias(RESCUED), F.col(f"_r.{CORRUPT}"), "source_file")
