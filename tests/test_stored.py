"""Stored tables: merges, versions, changes that come twice, writers that meet."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import changes
from tessera.sources.stored import StoredTable, exists


def _rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"n{i}", i % 3) for i in range(50)], "id long, name string, batch int")
    return StoredTable(spark, f"file://{tmp_path}/t").create(rows, ["id"], buckets=8)


def test_merge_updates_inserts_and_deletes(spark, table):
    table.merge(spark.createDataFrame([(3, "three", 9), (99, "new", 9)], "id long, name string, batch int"))
    assert _rows(table.read().filter("batch = 9"), "id", "name") == [(3, "three"), (99, "new")] and table.read().count() == 51
    table.merge(spark.createDataFrame([(4, "only the name"), (100, "not there")], "id long, name string"), insert=False)
    assert _rows(table.read().filter("id IN (4, 100)"), "id", "name", "batch") == [(4, "only the name", 1)]
    table.merge(spark.createDataFrame([(4,), (5,)], "id long"), delete=F.col("new.id") == 5)
    assert _rows(table.read().filter("id IN (4, 5)"), "id", "name") == [(4, "only the name")]
    table.update(F.col("batch") == 2, {"name": F.concat("name", F.lit("!"))})
    assert {r["name"] for r in table.read().filter("batch = 2").collect()} == {f"n{i}!" for i in range(50) if i % 3 == 2 and i != 5}


def test_only_touched_parts_are_written(spark, table):
    before = table.manifest()
    table.merge(spark.createDataFrame([(7, "seven", 1)], "id long, name string, batch int"))
    after = table.manifest()
    assert sum(after.parts[b] != before.parts[b] for b in before.parts) == 1
    assert table.read(before.version).filter("id = 7").first()["name"] == "n7" and table.read().filter("id = 7").first()["name"] == "seven"


def test_numbered_changes_count_once(spark, table):
    plus = {"batch": F.coalesce(F.col("old.batch"), F.lit(0)) + F.col("new.batch"), "name": F.col("new.name"), "id": F.col("new.id")}
    change = spark.createDataFrame([(1, "x", 10), (200, "y", 10)], "id long, name string, batch int")
    assert table.merge(change, plus, source="s", number=0) and not table.merge(change, plus, source="s", number=0)
    assert table.merge(change, plus, source="s", number=1) and not table.merge(change, plus, source="s", number=0)
    assert _rows(table.read().filter("id IN (1, 200)"), "id", "batch") == [(1, 21), (200, 20)]


def test_of_two_writers_one_fails(spark, table):
    seen = table.manifest()
    table.update(F.col("id") == 1, {"name": F.lit("first")})
    with pytest.raises(RuntimeError):
        table._write(table.read(), seen, list(range(8)), None, None)
    assert table.read().filter("id = 1").first()["name"] == "first" and table.read().count() == 50


def test_null_keys_and_empty_tables(spark, tmp_path):
    empty = StoredTable(spark, f"file://{tmp_path}/e")
    assert not exists(spark, f"file://{tmp_path}/e")
    empty.create(spark.createDataFrame([], "a string, b long"), ["a"])
    assert empty.read().collect() == []
    empty.merge(spark.createDataFrame([(None, 1), ("x", 2)], "a string, b long"))
    empty.merge(spark.createDataFrame([(None, 5)], "a string, b long"))
    assert {r["a"]: r["b"] for r in empty.read().collect()} == {None: 5, "x": 2}


def test_finds_survive_a_replay(spark, tmp_path):
    path = f"file://{tmp_path}/k"
    kinds = "lei_code string, legal_name string, frequency long, last_seen long"
    StoredTable(spark, path).create(spark.createDataFrame([("A", "old", 3, None)], kinds), ["lei_code"])
    finds = lambda rows: spark.createDataFrame(rows, "lei_code string, legal_name string, found_at long")
    for number in (0, 0, 1, 1, 0):
        changes.accumulate(finds([("A", "newer", 5), ("B", "b", 1)] if number == 0 else [("A", "late news", 4), ("B", "bb", 2), ("B", "b", 1)]), number, path)
    assert _rows(StoredTable(spark, path).read(), "lei_code", "legal_name", "frequency", "last_seen") == [("A", "newer", 5, 5), ("B", "bb", 3, 2)]
    folder = f"{tmp_path}/in"
    finds([("C", "c", 1)]).write.parquet(folder)
    stream = lambda: changes.follow_finds(spark.readStream.schema("lei_code string, legal_name string, found_at long").parquet(folder), path, f"{tmp_path}/c{len(os.listdir(tmp_path))}", availableNow=True).awaitTermination()
    stream()  # its first micro batch has a number that the table has taken, so it changes nothing
    assert StoredTable(spark, path).read().filter("lei_code = 'C'").count() == 0
