"""A partitioned Parquet table whose writes are whole or not at all.

A write reads and replaces the partitions that it touches and no others. Their new files are written to a folder of
their own; one small commit file, put in place by a rename that fails if it is there already, then makes them the
table's. Readers follow the newest commit, so whatever moment a writer dies at, they see the old table or the new one. A
commit names the folder of each partition, the number it follows, and the batch that it was made for: a batch that has
been committed is not written again. Of two writers that follow the same commit one starts anew.

Only names of partitions, such as months, and of folders pass through the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import partial
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from navella.sources.price_files import insert_absent, replace_snapshots, upsert

#: Times that a write starts anew when others were faster.
TRIES = 10


class PartitionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, partition: str):
        """partition: the column, a string, by whose values the rows are parted."""
        self.spark, self.path, self.partition = spark, path.rstrip("/"), partition
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self._jvm = spark._jvm

    def _file(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self) -> list[int]:
        fs, folder = self._file("commits")
        if not fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def commit_of(self, number: int | None = None) -> dict:
        """The commit of a number, or the newest; before any, one without partitions and of number 0."""
        numbers = self._numbers()
        if number is None:
            number = numbers[-1] if numbers else 0
        if number not in numbers:
            return {"number": 0, "folders": {}, "batches": {}}
        fs, path = self._file(f"commits/{number:012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, commit: dict) -> bool:
        """Puts a commit in place; false if its number is taken."""
        fs, aside = self._file(f"commits/.{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(commit).encode()))
        out.close()
        _, place = self._file(f"commits/{commit['number']:012d}.json")
        if not fs.exists(place) and fs.rename(aside, place):
            return True
        fs.delete(aside, False)
        return False

    def read(self, partitions: list[str] | None = None, number: int | None = None) -> DataFrame:
        """The table, or some of its partitions, as of the newest commit or that of a number."""
        folders = self.commit_of(number)["folders"]
        wanted = [f for p, f in folders.items() if partitions is None or p in partitions]
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{f}" for f in wanted))

    def write(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], batch: tuple[str, int] | None = None) -> int:
        """Replaces the partitions that new has rows in by merge(their rows, new) and returns the commit's number. batch: a
        writer's name and the number of its batch; once that or a later one of the same writer is committed, nothing is
        written. A merge must keep rows in their partitions. Rows of a null partition are an error."""
        partitions = [r[0] for r in new.select(self.partition).distinct().collect()]  # names of partitions only
        if None in partitions:
            raise ValueError(f"rows without {self.partition}")
        for _ in range(TRIES):
            at = self.commit_of()
            if not partitions or batch and at["batches"].get(batch[0], -1) >= batch[1]:
                return at["number"]
            folder = uuid.uuid4().hex
            rows = merge(self.read(partitions), new.select(*self.schema.names))
            staged = rows.select(*self.schema.names, F.col(self.partition).alias("_partition"))
            staged.write.partitionBy("_partition").parquet(f"{self.path}/data/{folder}")
            kept = {p: f for p, f in at["folders"].items() if p not in partitions}
            made = {p: f"{folder}/_partition={_escaped(p)}" for p in partitions}
            fs, _ = self._file("data")
            made = {p: f for p, f in made.items() if fs.exists(self._file(f"data/{f}")[1])}  # those that have rows left
            batches = at["batches"] | ({batch[0]: batch[1]} if batch else {})
            if self._put({"number": at["number"] + 1, "folders": kept | made, "batches": batches}):
                return at["number"] + 1
        raise RuntimeError(f"other writers were faster {TRIES} times")

    def upsert(self, new: DataFrame, keys: list[str], batch: tuple[str, int] | None = None) -> int:
        """One row a key; the new one where both have it."""
        return self.write(new, partial(upsert, keys=keys), batch)

    def insert_absent(self, new: DataFrame, keys: list[str], batch: tuple[str, int] | None = None) -> int:
        """Rows whose key the table lacks."""
        return self.write(new, partial(insert_absent, keys=keys), batch)

    def replace(self, new: DataFrame, snapshot: list[str], batch: tuple[str, int] | None = None) -> int:
        """Snapshots, or the pages of documents, as a whole: what the table has of those in new goes."""
        return self.write(new, partial(replace_snapshots, snapshot=snapshot), batch)

    def vacuum(self) -> int:
        """Deletes the folders of writes that the newest commit doesn't hold, as those that were broken off, and returns how many.
        Not while others read or write."""
        held = {f.partition("/")[0] for f in self.commit_of()["folders"].values()}
        fs, folder = self._file("data")
        loose = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName() not in held] if fs.exists(folder) else []
        for path in loose:
            fs.delete(path, True)
        return len(loose)


def _escaped(value: str) -> str:
    """A partition's value as Spark writes it in a folder's name; values of letters, digits, dots, dashes and underlines stay."""
    if quote(value, safe="") != value or value.startswith(("_", ".")):
        raise ValueError(f"not a partition's name: {value!r}")
    return value


def reloaded(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documents (sha256, retrieved_at, ..): those that are known keep all but retrieved_at, which moves on; new ones come in."""
    rest = [c for c in old.columns if c not in ("sha256", "retrieved_at")]
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("_new", F.lit(1)))
    first = rows.groupBy("sha256").agg(F.min(F.struct("_new", *rest)).alias("first"), F.max("retrieved_at").alias("retrieved_at"))
    return first.select("sha256", "retrieved_at", *(f"first.{c}" for c in rest)).select(*old.columns)
