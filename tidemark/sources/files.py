"""Manifests, listings, caches: how tables come in and go out."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, a byte order mark or not; columns by the schema given, nothing inferred."""
    return spark.read.csv(path, header=True, schema=schema, encoding="UTF-8", enforceSchema=False)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one a file or in arrays."""
    return spark.read.schema(schema).json(path, multiLine=True)


def entries(rows: DataFrame, column: str, key: str = "key", value: str = "value") -> DataFrame:
    """A map column as rows: how JSON keyed by id is read."""
    return rows.select(*[c for c in rows.columns if c != column], F.explode(column).alias(key, value))


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, modified) of the files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def file_key(path: Column) -> Column:
    """A path's name without folders and ending, with forward slashes and in lower case, to join listings by."""
    return F.lower(F.regexp_replace(F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1), r"\.[^.]*$", ""))


def shard(rows: DataFrame, id_col: str, index: int, count: int) -> DataFrame:
    """The rows of one of `count` shares, by hash of the id."""
    return rows.where(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(count)) == index)


def beat_grid(spark: SparkSession, bpm: float, beats_per_bar: int, beats: int) -> DataFrame:
    """(beat, seconds, downbeat): an even grid."""
    return spark.range(beats).select(F.col("id").alias("beat"), (F.col("id") * 60.0 / bpm).alias("seconds"), (F.pmod("id", F.lit(beats_per_bar)) == 0).alias("downbeat"))


def content_key(*columns: str) -> Column:
    """SHA-1 over columns: the name of a result by what it was made from."""
    return F.sha1(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]))


def write_cache(rows: DataFrame, folder: str, key: str, buckets: int = 64, partition: str | None = None) -> None:
    """Parquet for reads by key: files hold key ranges in order, so a read of one key touches a row group or two.

    All is written beside the folder first and then takes its name, so that a write that fails leaves the cache as it was.
    """
    out = rows.repartitionByRange(buckets, *([partition] if partition else []), key).sortWithinPartitions(*([partition] if partition else []), key)
    aside = f"{folder.rstrip('/')}.new-{uuid.uuid4().hex}"
    (out.write.partitionBy(partition) if partition else out.write).parquet(aside)
    replace(rows.sparkSession, aside, folder)


def replace(spark: SparkSession, new: str, folder: str) -> None:
    """Gives a written folder another one's name: two renames, and only then the older contents go."""
    jvm = spark.sparkContext._jvm
    at, to, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (new, folder, f"{folder.rstrip('/')}.old-{uuid.uuid4().hex}"))
    files = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = files.exists(to)
    if had and not files.rename(to, old):
        raise OSError(f"{folder} can't be moved aside")
    if not files.rename(at, to):
        if had:
            files.rename(old, to)
        raise OSError(f"{new} can't take the name {folder}")
    if had:
        files.delete(old, True)


def read_cache(spark: SparkSession, folder: str, key: str, *values) -> DataFrame:
    """The rows of some keys, by pushed-down filter."""
    rows = spark.read.parquet(folder)
    return rows.where(F.col(key).isin(*values)) if values else rows


def resume(spark: SparkSession, todo: DataFrame, folder: str, on: list[str]) -> DataFrame:
    """What of `todo` the output folder doesn't have yet; all of it where there is no folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return todo
    return todo.join(spark.read.parquet(folder).select(*on).distinct(), on, "left_anti")


def overlay(rows: DataFrame, document: str, defaults: dict[str, str]) -> DataFrame:
    """A map column over defaults: given values win."""
    base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    given = F.coalesce(F.col(document), F.create_map().cast("map<string,string>"))
    return rows.withColumn(document, F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(given, k)), given))
