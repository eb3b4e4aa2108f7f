"""New price files as a stream into a table with one row for each plan and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from navella.sources.partitioned_table import PartitionedTable
from navella.sources.price_files import parse_price_text

SCHEMA = "code string, date date, nav double, month string"


def price_table(spark: SparkSession, path: str) -> PartitionedTable:
    return PartitionedTable(spark, path, SCHEMA, "month")


def watch(spark: SparkSession, landing: str, table: str, checkpoint: str) -> StreamingQuery:
    """Takes what has landed and merges it by (code, date) into a price_table, parted by month. A batch reads and replaces the
    months that it has rows of and no others, in one commit under its number, so one that is run again after a crash is
    written once; the row of the later batch stays, and late rows need no watermark."""

    def merge(batch: DataFrame, number: int) -> None:
        rows = parse_price_text(batch).select("code", "date", "nav").filter("date is not null and nav is not null")
        rows = rows.withColumn("month", F.date_format("date", "yyyy-MM"))
        price_table(batch.sparkSession, table).upsert(rows, ["code", "date"], (checkpoint, number))

    files = spark.readStream.text(landing, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
