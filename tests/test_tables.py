"""Stored tables: merges by bucket, database reads."""

import random

from pyspark.sql import functions as F

from reelframe.operators.library import renumbered
from reelframe.sources.buckets import BucketedTable
from reelframe.sources.databases import read_table, write_table


def files(path):
    return {str(f.relative_to(path)) for f in path.glob("bucket=*/part-*")}


def test_a_merge_rewrites_only_what_it_changes(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), ["k"], 16)
    rows = {k: (k, 0, f"v{k}") for k in range(300)}
    table.create(spark.createDataFrame(list(rows.values()), "k long, at long, v string"))
    before = files(tmp_path / "t")
    assert len({f.split("/")[0] for f in before}) == 16
    changes = [(5, 1, "new"), (5, 2, "newer"), (1000, 1, "added"), (7, 1, None)]
    touched = table.merge(spark.createDataFrame(changes, "k long, at long, v string"), "at")
    rows |= {5: (5, 2, "newer"), 1000: (1000, 1, "added"), 7: (7, 1, None)}
    assert sorted(map(tuple, table.read().collect()), key=str) == sorted(rows.values(), key=str)
    after = files(tmp_path / "t")
    same = {f for f in before if int(f.split("/")[0].split("=")[1]) not in touched}
    assert 1 <= len(touched) <= 3 and same <= after and not (before - same) & after
    # The same merge again gives the same table.
    table.merge(spark.createDataFrame(changes, "k long, at long, v string"), "at")
    assert table.read().count() == len(rows)
    assert table.merge(spark.createDataFrame([], "k long, at long, v string"), "at") == [] and table.read().count() == len(rows)


def test_a_merge_reads_only_the_buckets_of_its_changes(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), ["k"], 16)
    table.create(spark.range(300).select(F.col("id").alias("k"), F.lit(0).alias("at")))
    # A damaged file of another bucket would fail a read of the whole table.
    touched = table.touched(spark.createDataFrame([(5, 1)], "k long, at int"))
    for f in (tmp_path / "t").glob("bucket=*/part-*"):
        if int(f.parent.name.split("=")[1]) not in touched:
            f.write_bytes(b"damaged")
    assert table.merge(spark.createDataFrame([(5, 1)], "k long, at int"), "at") == touched


def test_tables_of_a_database(spark, tmp_path):
    url, driver = f"jdbc:derby:memory:d{random.randrange(10**9)};create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(1000).select(F.col("id").cast("int").alias("ID"), (F.col("id") % 7).cast("int").alias("KIND"), F.format_string("name %d", "id").alias("NAME"))
    write_table(rows.union(spark.createDataFrame([(None, 1, "none")], "ID int, KIND int, NAME string")).coalesce(1), url, "TITLES", **driver)
    found = read_table(spark, url, "TITLES", "ID", 4, **driver)
    assert found.rdd.getNumPartitions() == 4 and found.count() == 1001
    assert min(r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()) > 200
    few = found.where("KIND = 3 AND ID > 500").select("NAME")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(KIND), *IsNotNull(ID), *EqualTo(KIND,3), *GreaterThan(ID,500)]" in plan and "ReadSchema: struct<NAME:string>" in plan
    assert few.count() == len([k for k in range(501, 1000) if k % 7 == 3])
    assert read_table(spark, url, "TITLES", "ID", **driver).rdd.getNumPartitions() == 1
    write_table(rows.limit(0), url, "NO_TITLES", **driver)
    assert read_table(spark, url, "NO_TITLES", "ID", 4, **driver).count() == 0


def test_new_places_of_a_large_collection(spark):
    members = spark.createDataFrame([("a", k, 900 + k) for k in range(200)] + [("b", 1, 5)], "collection_slug string, media_id long, position long")
    order = [k for k in range(200) if k % 3]
    random.Random(1).shuffle(order)
    asked = spark.createDataFrame([("a", m, p * 10) for p, m in enumerate(order)], "collection_slug string, media_id long, place long")
    found = {(r.collection_slug, r.media_id): r.position for r in renumbered(members, asked).collect()}
    assert found == {("a", k): order.index(k) if k % 3 else 900 + k for k in range(200)} | {("b", 1): 5}
