"""The versioned store: versions, repeats, conflicts, pruning by files, deletes and clean-up."""

import pytest
from pyspark.sql import functions as F

from spindrift.sources.io import work_dir
from spindrift.sources.store import Conflict, Store

SCHEMA = "id long, space string, user long, version long, value double"


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


def made(spark, **more):
    return Store.create(spark, work_dir(spark, "store"), rows(spark).schema, ["id"], "version", namespace="space", scope="user", **({"buckets": 4} | more))


def said(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_versions_readers_and_repeats(spark):
    store = made(spark)
    first = rows(spark, *[(i, "a", i % 3, 1, i / 2) for i in range(40)], *[(i, "b", 9, 1, 0.5) for i in range(5)])
    assert store.upsert(first, "b1") == 1
    reader = store.read(1)
    before = said(reader)
    second = rows(spark, (3, "a", 0, 2, 7.0), (3, "b", 9, 0, 9.0), (100, "c", 1, 1, 1.0))
    assert store.upsert(second, "b2") == 2
    assert said(reader) == before == said(store.read(1)) and len(before) == 45
    now = {(r.space, r.id): r for r in store.read().collect()}
    assert now["a", 3].value == 7.0 and now["b", 3].value == 0.5 and len(now) == 46
    files = store.files()
    assert store.upsert(second, "b2") == 2 and store.files() == files  # a repeated batch changes nothing
    kept = {f.path for f in store.files(1)} & {f.path for f in files}
    assert len(store.files(1)) - len(kept) <= 2  # only touched buckets were written anew
    assert said(store.read(namespaces=["c"])) == [(100, "c", 1, 1, 1.0)]


def test_odd_rows(spark):
    store = made(spark)
    odd = rows(spark, (None, "a", 1, 1, 1.0), (None, "a", 1, 2, 2.0), (1, None, None, 1, 1.0), (1, "", 2, 1, 1.0), (2, "a/b=c %", 2, 1, 3.0), (2, "a/b=c %", 2, 1, 4.0), (2, "a/b=c %", 2, 1, 4.0))
    store.upsert(odd, "odd")
    assert said(store.read()) == sorted([(None, "a", 1, 2, 2.0), (1, None, None, 1, 1.0), (1, "", 2, 1, 1.0), (2, "a/b=c %", 2, 1, 4.0)], key=repr)
    assert said(store.read(namespaces=[None])) == [(1, None, None, 1, 1.0)]
    assert store.upsert(rows(spark), "nothing") == 2 and store.read().count() == 4
    assert store.delete(2)["deleted"] == 2 and store.read().count() == 2
    assert store.delete(77) == {"inserted": 0, "scanned_files": 0, "rewritten_files": 0, "kept_files": 2, "version": 3, "deleted": 0, "remaining": 0, "completed": True}


def test_delete_rewrites_only_files_that_hold_the_user(spark):
    store = made(spark, buckets=8)
    store.upsert(spark.range(400).select("id", F.lit("a").alias("space"), F.when(F.col("id") == 17, 50).otherwise(F.col("id") % 5 * 25).alias("user"), F.lit(1).alias("version"), F.lit(0.0).alias("value")), "all")
    before = {f.path for f in store.files()}
    report = store.delete(50)
    want = [i for i in range(400) if i == 17 or i % 5 == 2]
    assert report["inserted"] == report["deleted"] == len(want) and report["remaining"] == 0 and report["completed"]
    assert len({f.path for f in store.files()} & before) == report["kept_files"] == len(before) - report["rewritten_files"]
    assert {r.id for r in store.read().collect()} == set(range(400)) - set(want)
    assert store.read(1).count() == 400
    one = made(spark, buckets=8)
    one.upsert(spark.range(400).select("id", F.lit("a").alias("space"), F.when(F.col("id") == 17, 50).otherwise(F.col("id") % 2 * 100).alias("user"), F.lit(1).alias("version"), F.lit(0.0).alias("value")), "all")
    assert one.delete(50)["rewritten_files"] == 1 and one.read().count() == 399


def test_conflict_and_vacuum(spark):
    store = made(spark)
    store.upsert(rows(spark, (1, "a", 1, 1, 1.0)), "b1")
    other, publish, lost = Store(spark, store.root), store._publish, []

    def late(number, manifest):
        if not lost:
            lost.append(other.upsert(rows(spark, (2, "a", 1, 1, 2.0)), "b2"))
        return publish(number, manifest)

    store._publish = late
    assert store.upsert(rows(spark, (3, "a", 1, 1, 3.0)), "b3") == 3 and lost == [2]
    assert [r[0] for r in said(store.read())] == [1, 2, 3]
    store._publish = lambda n, m: False
    with pytest.raises(Conflict):
        store.upsert(rows(spark, (4, "a", 1, 1, 3.0)), "b4")
    with pytest.raises(FileExistsError):
        Store.create(spark, store.root, rows(spark).schema, ["id"], "version")
    assert other.vacuum() > 0 and other.read().count() == 3
