"""Writes that are whole or not at all."""

import pytest
from pyspark.sql import functions as F

from navella.sources.partitioned_table import PartitionedTable, reloaded

SCHEMA = "k long, v string, month string"


def table(spark, path):
    return PartitionedTable(spark, str(path), SCHEMA, "month")


def rows(spark, *data):
    return spark.createDataFrame(data, SCHEMA)


def held(t, **kw):
    return sorted(map(tuple, t.read(**kw).collect()))


def test_upserts_replace_touched_partitions_alone(spark, tmp_path):
    t = table(spark, tmp_path)
    assert held(t) == [] and t.upsert(rows(spark), ["k"]) == 0
    assert t.upsert(rows(spark, (1, "a", "2024-01"), (2, "b", "2024-02")), ["k"]) == 1
    before = t.commit_of()["folders"]
    assert t.upsert(rows(spark, (2, "c", "2024-02"), (3, "d", "2024-02")), ["k"]) == 2
    after = t.commit_of()["folders"]
    assert held(t) == [(1, "a", "2024-01"), (2, "c", "2024-02"), (3, "d", "2024-02")]
    assert after["2024-01"] == before["2024-01"] and after["2024-02"] != before["2024-02"]
    assert held(t, number=1) == [(1, "a", "2024-01"), (2, "b", "2024-02")]
    assert held(t, partitions=["2024-01"]) == [(1, "a", "2024-01")]
    assert t.insert_absent(rows(spark, (3, "z", "2024-02"), (4, "e", "2024-02")), ["k"]) == 3
    assert held(t, partitions=["2024-02"]) == [(2, "c", "2024-02"), (3, "d", "2024-02"), (4, "e", "2024-02")]
    with pytest.raises(ValueError, match="without month"):
        t.upsert(rows(spark, (9, "x", None)), ["k"])


@pytest.mark.parametrize("moment", ["while staging", "before the commit", "during the commit"])
def test_a_killed_write_leaves_the_old_table(spark, tmp_path, monkeypatch, moment):
    t = table(spark, tmp_path)
    t.upsert(rows(spark, (1, "a", "2024-01")), ["k"])
    new = rows(spark, (1, "b", "2024-01"), (2, "c", "2024-02"))

    class Killed(Exception):
        pass

    def die(*_):
        raise Killed

    def half(self, _):
        fs, aside = self._file("commits/.half")
        fs.create(aside, False).close()
        raise Killed

    with monkeypatch.context() as patch, pytest.raises(Exception, match="killed|Killed|^$"):
        if moment == "while staging":
            t.write(new, lambda old, more: more.withColumn("v", F.raise_error(F.lit("killed")).cast("string")))
        elif moment == "before the commit":
            patch.setattr(PartitionedTable, "_put", die)
            t.upsert(new, ["k"])
        else:
            patch.setattr(PartitionedTable, "_put", half)
            t.upsert(new, ["k"])
    assert held(t) == [(1, "a", "2024-01")] and t.commit_of()["number"] == 1
    assert t.vacuum() == 1
    assert t.upsert(new, ["k"], ("w", 0)) == 2 and held(t) == [(1, "b", "2024-01"), (2, "c", "2024-02")]
    assert t.vacuum() == 1 and held(t) == [(1, "b", "2024-01"), (2, "c", "2024-02")]


def test_a_batch_is_written_once(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.upsert(rows(spark, (1, "a", "m")), ["k"], ("stream", 0)) == 1
    assert t.upsert(rows(spark, (1, "again", "m")), ["k"], ("stream", 0)) == 1
    assert t.upsert(rows(spark, (1, "b", "m")), ["k"], ("other", 0)) == 2
    assert t.upsert(rows(spark, (1, "c", "m")), ["k"], ("stream", 1)) == 3 and held(t) == [(1, "c", "m")]


def test_the_slower_writer_starts_anew(spark, tmp_path):
    t, other = table(spark, tmp_path), table(spark, tmp_path)
    t.upsert(rows(spark, (1, "a", "m")), ["k"])
    calls = []

    def merge(old, new):
        if not calls:
            other.upsert(rows(spark, (2, "fast", "m")), ["k"])
        calls.append(1)
        return old.unionByName(new)

    assert t.write(rows(spark, (3, "slow", "m")), merge) == 3 and len(calls) == 2
    assert held(t) == [(1, "a", "m"), (2, "fast", "m"), (3, "slow", "m")]


def test_snapshots_and_pages_are_replaced_whole(spark, tmp_path):
    t = PartitionedTable(spark, str(tmp_path), "doc_id string, page_number long, text string, shelf string", "shelf")
    pages = lambda *r: spark.createDataFrame(r, t.schema)
    t.replace(pages(("a", 1, "x", "s"), ("a", 2, "y", "s"), ("b", 1, "z", "s")), ["doc_id"])
    t.replace(pages(("a", 1, "new", "s")), ["doc_id"])
    assert held(t) == [("a", 1, "new", "s"), ("b", 1, "z", "s")]


def test_a_document_that_is_loaded_again_keeps_all_but_its_time(spark):
    docs = lambda *r: spark.createDataFrame(r, "sha256 string, url string, retrieved_at string")
    old, new = docs(("a", "u1", "2024-01")), docs(("a", "u2", "2024-03"), ("b", "u3", "2024-03"))
    assert sorted(map(tuple, reloaded(old, new).collect())) == [("a", "u1", "2024-03"), ("b", "u3", "2024-03")]
    assert sorted(map(tuple, reloaded(reloaded(old, new), new).collect())) == [("a", "u1", "2024-03"), ("b", "u3", "2024-03")]
