"""Shards: whole rows through appends and compaction, files near the target, and commits that never overwrite."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.llm import sharding
from tidemark.llm.sharding import ShardStore, VersionTaken


def _rows(df):
    return sorted(map(repr, df.collect()))


def _docs(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.sha2(F.col("id").cast("string"), 512), (F.col("id") % 5).cast("int")).alias("text"), F.lit(1).alias("bytes"), F.lit("x").alias("tier"), F.lit("f").alias("__file"), F.lit(3).alias("__merged"), F.struct(F.lit("p").alias("file_path")).alias("_metadata"))
    odd = [(None, None, 1, "x", None, 1, None), (7, "", 1, "x", "f", None, None), (7, "", 1, "x", "f", None, None), (8, "z" * 300_000, 1, "x", "", 5, ("q",))]
    kinds = "doc_id long, text string, bytes int, tier string, __file string, __merged int, _metadata struct<file_path:string>"
    return docs.unionByName(spark.createDataFrame(odd, kinds))


def test_rows_survive_and_files_reach_the_target(spark, tmp_path):
    docs = _docs(spark)
    store = ShardStore(spark, f"{tmp_path}/store")
    assert store.version() == 0
    for k in range(3):
        store.append(docs.where(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3)) == k), max_rows=100)
    before = store.manifest().count()
    assert _rows(store.read(docs.schema)) == _rows(docs)
    assert store.compact(docs.schema, 100_000) > 3
    files = store.manifest().collect()
    assert len(files) < before and sum(r.rows for r in files) == docs.count()
    assert all(os.path.getsize(r.file.split(":", 1)[-1]) == r.bytes for r in files)
    assert max(r.bytes for r in files) < 4 * 100_000
    assert _rows(store.read(docs.schema)) == _rows(docs)
    store.expire()
    assert _rows(store.read(docs.schema, 3)) == _rows(docs)  # readers of a recent version
    store.expire(0)
    assert store._versions().keys() == {store.version()}
    assert _rows(store.read(docs.schema)) == _rows(docs)


def test_compaction_reads_the_planned_files_only(spark, tmp_path, monkeypatch):
    docs = _docs(spark).where("doc_id < 1000").select("doc_id", "text")
    store = ShardStore(spark, f"{tmp_path}/store")
    store.append(docs.coalesce(1), max_rows=100_000)
    big = {r.file for r in store.manifest().collect()}
    for k in range(4):
        store.append(docs.where(F.pmod("doc_id", F.lit(16)) == k).coalesce(1))
    planned = {r.file for r in store.plan(1 << 20).collect()}
    assert len(planned) == 4 and not planned & big
    read = []
    real = type(spark.read).parquet
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *paths, **o: (read.extend(paths), real(self, *paths, **o))[1])
    store.compact(docs.schema, 1 << 20)
    assert {p for p in read if "/data/a" in p} == planned
    assert big < {r.file for r in store.manifest().collect()}
    v = store.version()
    assert store.compact(docs.schema, 1 << 20) == v  # a lone file in a tier is left alone


def test_compaction_in_several_commits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "PLAN_FILES", 3)
    docs = _docs(spark).where("doc_id < 900").select("doc_id", "text")
    store = ShardStore(spark, f"{tmp_path}/store")
    store.append(docs.repartition(8, "doc_id"))
    store.compact(docs.schema, 1 << 20)
    assert store.manifest().count() < 8 and store.version() > 2
    assert _rows(store.read(docs.schema)) == _rows(docs)


def test_a_taken_version_is_refused(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    one, two = ShardStore(spark, f"{tmp_path}/store"), ShardStore(spark, f"{tmp_path}/store")
    one.append(docs)
    two.version = lambda: 0  # it looked before the other one committed
    with pytest.raises(VersionTaken):
        two.append(docs.where("doc_id = 1"))
    assert one.version() == 1
    assert _rows(one.read(docs.schema)) == _rows(docs)


def test_expire_leaves_an_append_alone_that_has_not_committed(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    one, two = ShardStore(spark, f"{tmp_path}/store"), ShardStore(spark, f"{tmp_path}/store")
    one.append(docs)
    real, commit = two._listed, lambda folder, schema: (one.expire(), real(folder, schema))[1]
    two._listed = commit
    two.append(docs.where("doc_id = 1"))
    assert _rows(two.read(docs.schema)) == _rows(docs.unionByName(docs.where("doc_id = 1")))


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    store = ShardStore(spark, f"{tmp_path}/store")
    store.append(docs)
    store.compact(docs.schema, 1000)
    assert store.read(docs.schema).count() == 0
