"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI under ``spark.checkpoint.dir``. Where that is unset, a local session, as in tests, takes a
    temporary folder of this machine and sets it as the checkpoint folder; any other raises, as its executors share
    no such folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-navella-")
        spark.sparkContext.setCheckpointDir(root)
    if "://" not in root and not root.startswith("file:"):
        root = f"file://{root}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: a lost executor costs no earlier work."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table that stored wrote and that nothing reads any more, as those of earlier rounds of a loop."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with place (from 0, within their value of group, in the order of columns, nulls first) and total, the rows of
    that value. The order is made by range partitions, which split rows of one value, and equal rows too; counts of each
    value in each partition then tell where its rows begin, so no value's rows meet in one task. group has no nulls."""
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in (group, *order, "_tie")]
    sorted_rows = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # its low bits count a partition's rows
    sorted_rows = stored(sorted_rows.withColumns({"_part": F.spark_partition_id(), "_row": row}), name)
    runs = sorted_rows.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    each = Window.partitionBy(group)  # as many rows as there are partitions, at most
    before = F.coalesce(F.sum("_n").over(each.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(group, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(each).alias("total"))
    return sorted_rows.join(runs, [group, "_part"]).withColumn("place", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")


def with_fields(schema: StructType, ddl: str) -> StructType:
    """A schema of the fields of another and those of a DDL string."""
    return StructType(schema.fields + StructType.fromDDL(ddl).fields)
