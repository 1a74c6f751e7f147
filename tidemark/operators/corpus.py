"""Operators over whole corpora: splits, exclusion, overlap, linting, stable ids."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .ranks import global_rank


def split_of(id_col: Column, val: float, test: float = 0.0) -> Column:
    """0 train, 1 validation, 2 test, by crc32 of the id, in percent."""
    b = F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(10_000)) / 100.0
    return F.when(b < val, 1).when(b < val + test, 2).otherwise(0)


def md5_split_of(id_col: Column, val: float, test: float = 0.0) -> Column:
    """The same by the first eight digits of md5, which other engines have too."""
    b = F.pmod(F.conv(F.substring(F.md5(id_col.cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(10_000)) / 100.0
    return F.when(b < val, 1).when(b < val + test, 2).otherwise(0)


def exclude(rows: DataFrame, listed: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(listed.select(*on).distinct(), on, "left_anti")


def dedupe_longest(rows: DataFrame, keys: list[str], length: str, tie: list[str]) -> DataFrame:
    """Of rows equal in keys, the longest; the first by `tie` among equals. Combines before it shuffles."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct((-F.col(length)).alias("l"), *tie))
    return rows.groupBy(*keys).agg(best.alias("__best")).select(*keys, "__best.*")


def latest(rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The newest row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("__r")).select(*keys, "__r.*")


def ngrams(rows: DataFrame, keys: list[str], text: str, n: int) -> DataFrame:
    """(keys, gram): the distinct n-grams of words of each text."""
    words = F.filter(F.split(F.lower(text), r"[^a-z0-9à-ÿß]+"), lambda w: w != "")
    grams = F.transform(F.sequence(F.lit(1), F.size("__w") - n + 1), lambda i: F.array_join(F.slice("__w", i, n), " "))
    return (
        rows.select(*keys, words.alias("__w")).where(F.size("__w") >= n)
        .select(*keys, F.explode(F.array_distinct(grams)).alias("gram"))
    )


_WORD = re.compile("[a-z0-9à-ÿß]+")
_ODD = [int(x) | 1 for x in np.random.default_rng(5).integers(0, 1 << 64, 64, dtype=np.uint64)]


def _hashes_of(words: list[str], n: int, known: dict[str, int]) -> np.ndarray:
    """The sorted distinct hashes of the n-grams of at least n words. known: hashes of words so far."""
    w = np.fromiter((known.get(x) or known.setdefault(x, xxhash.xxh64_intdigest(x)) for x in words), np.uint64, len(words))
    h = np.zeros(len(w) - n + 1, np.uint64)
    for j in range(n):
        h = (h + w[j : j + len(h)]) * np.uint64(_ODD[j % len(_ODD)])
        h ^= h >> np.uint64(29)
    return np.unique(h.view(np.int64))


def _gram_hashes(rows: DataFrame, key: str, text: str, n: int, asked: Broadcast | None = None) -> DataFrame:
    """(key, hash): the distinct hashes of the n-grams of words of each text; of `asked`, a sorted array, only."""
    kind = StructType([StructField(key, rows.schema[key].dataType), StructField("hash", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some, at, found = batch.slice(start, 500), [], []
                for i, t in enumerate(some.column(1)):
                    words = _WORD.findall(t.as_py().decode("utf-8", "replace")) if t.is_valid else []
                    if len(words) < n:
                        continue
                    h = _hashes_of(words, n, known)
                    if asked is not None:
                        h = h[_among(h, asked.value)]
                    at.append(np.full(len(h), i, np.int64))
                    found.append(h)
                    if len(known) > 100_000:
                        known.clear()
                at, found = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, found))
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(at)), pa.array(found)], names=[key, "hash"])

    return rows.select(key, F.lower(text).cast("binary").alias("__text")).mapInArrow(run, kind)


def _among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each of x is in the sorted array."""
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def containment_of(queries: DataFrame, corpus: DataFrame, query_id: str, corpus_id: str, text: str, n: int, threshold: float) -> DataFrame:
    """(query_id, corpus_id, shared, containment): shares of the distinct n-grams of queries found in texts of a corpus.

    Grams are first compared by their hashes, which can only find too much: a text whose hashes are too few for every
    query is left out. Grams of the others are then spelt and counted. Up to ``BROADCAST_GRAMS`` hashes of queries go to
    the corpus, of whose hashes only those that are asked for leave their task.
    """
    asked = _gram_hashes(queries, query_id, text, n)
    spelt = ngrams(queries, [query_id], text, n)
    size = asked.groupBy(query_id).agg(F.count("*").alias("__hashes")).join(spelt.groupBy(query_id).agg(F.count("*").alias("__size")), query_id)
    some = asked.select("hash").limit(BROADCAST_GRAMS + 1).toArrow().column("hash").to_numpy()
    few = len(some) <= BROADCAST_GRAMS
    sent = queries.sparkSession.sparkContext.broadcast(np.unique(some)) if few else None
    found = _gram_hashes(corpus, corpus_id, text, n, sent).join(F.broadcast(asked) if few else asked, "hash").groupBy(query_id, corpus_id).agg(F.count("*").alias("__n"))
    # grams of a query that share a hash count once, so as many may be missing
    enough = F.col("__n") + F.col("__size") - F.col("__hashes") >= threshold * F.col("__size")
    maybe = found.join(size, query_id).where(enough).select(corpus_id).distinct()
    ids = maybe.limit(BROADCAST_GRAMS + 1).toArrow()
    if ids.num_rows <= BROADCAST_GRAMS:
        maybe = F.broadcast(queries.sparkSession.createDataFrame(ids, maybe.schema))
    # as it is: else the condition on a text's words would be pushed below the join, and every text split
    some = corpus.select(corpus_id, text).join(maybe, corpus_id, "left_semi")
    some = some.mapInArrow(lambda batches: batches, some.schema)
    return containment(spelt, ngrams(some, [corpus_id], text, n), query_id, corpus_id, threshold)


#: Grams of queries, and ids of texts, that may be broadcast.
BROADCAST_GRAMS = 200_000


def containment(query: DataFrame, corpus: DataFrame, query_id: str, corpus_id: str, threshold: float) -> DataFrame:
    """(query_id, corpus_id, shared, containment): shares of a query's distinct grams found in a corpus item.

    The queries' grams are counted first. Up to ``BROADCAST_GRAMS`` of them (some 20 MB) go to the corpus, whose grams
    then never move; beyond, both sides are dealt by gram.
    """
    size = query.groupBy(query_id).agg(F.countDistinct("gram").alias("__size"))
    asked = query.select(query_id, "gram").distinct()
    few = asked.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS
    shared = corpus.join(F.broadcast(asked) if few else asked, "gram").groupBy(query_id, corpus_id).agg(F.countDistinct("gram").alias("shared"))
    out = shared.join(size, query_id).withColumn("containment", F.col("shared") / F.col("__size"))
    return out.where(F.col("containment") >= threshold).drop("__size")


def mask_ngrams(masks: DataFrame, keys: list[str], position: str, mask: str) -> DataFrame:
    """(keys, gram): five consecutive 12-bit masks in a 60-bit number; all-equal runs are left out."""
    w = Window.partitionBy(*keys).orderBy(position)
    m = [F.col(mask).cast("long")] + [F.lead(mask, k).over(w).cast("long") for k in range(1, 5)]
    gram = sum((F.call_function("shiftleft", c, F.lit(48 - 12 * i)) for i, c in enumerate(m[1:], 1)), F.call_function("shiftleft", m[0], F.lit(48)))
    flat = (m[0] == m[1]) & (m[1] == m[2]) & (m[2] == m[3]) & (m[3] == m[4])
    return masks.select(*keys, gram.alias("gram"), flat.alias("__flat")).where("gram is not null and not __flat").drop("__flat")


#: Limits above which a rule makes a text low in quality.
LIMITS = {"bar_rate": 0.02, "upper_rate": 0.5, "sign_rate": 0.05, "digit_rate": 0.2}


def lint(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Rates of each rule over characters (one at least), and the verdict."""
    n = F.greatest(F.length(text), F.lit(1))
    rules = {"bar_rate": r"\|", "upper_rate": r"[A-Z]", "sign_rate": r"[$%&*#]", "digit_rate": r"[0-9]"}
    out = rows.select(*keys, *[F.bround(F.coalesce(F.regexp_count(F.col(text), F.lit(p)), F.lit(0)) / n, 6).alias(k) for k, p in rules.items()])
    low = F.exists(F.array(*[F.col(k) > v for k, v in LIMITS.items()]), lambda x: x)
    return out.withColumn("low_quality", low)


def reject_reasons(rows: DataFrame, reasons: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, counts by the first reason that applies)."""
    why = F.lit(None).cast("string")
    for name, rule in reversed(reasons.items()):
        why = F.when(F.coalesce(rule, F.lit(False)), name).otherwise(why)
    marked = rows.withColumn("reason", why)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def stable_ids(known: DataFrame, names: DataFrame, name: str, id_col: str) -> DataFrame:
    """Known ids stay; new names get the ids after them, in order of name."""
    new = names.select(name).where(F.col(name).isNotNull()).distinct().join(known, name, "left_anti")
    top = known.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("__top"))
    fresh = global_rank(new, [name], "__n").join(F.broadcast(top)).select(name, (F.col("__top") + F.col("__n")).alias(id_col))
    return known.select(name, id_col).unionByName(fresh)


def prefer(base: DataFrame, first: DataFrame, second: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """base with columns of the first relation that has the key, else of the second."""
    a = first.select(*keys, F.struct(*columns).alias("__a"))
    b = second.select(*keys, F.struct(*columns).alias("__b"))
    return base.join(a, keys, "left").join(b, keys, "left").withColumn("__c", F.coalesce("__a", "__b")).select(*base.columns, *[F.col(f"__c.{c}").alias(c) for c in columns])


def override(base: DataFrame, patches: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """base with columns replaced where a patch names the key."""
    p = patches.select(*keys, F.struct(*columns).alias("__p"))
    return base.join(p, keys, "left").select(*[F.when(F.col("__p").isNotNull(), F.col(f"__p.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def still_to_do(rows: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """What an earlier run hasn't written yet."""
    return exclude(rows, done, on)


def vector_moments(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, dim, n, mean, variance) of the components of vectors."""
    return rows.select(*keys, F.posexplode(vector).alias("dim", "x")).groupBy(*keys, "dim").agg(F.count("x").alias("n"), F.avg(F.col("x").cast("double")).alias("mean"), F.var_pop(F.col("x").cast("double")).alias("variance"))


def vector_covariance(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, i, j, n, covariance) of components i <= j, over vectors that have both; summed in each partition before the shuffle."""
    one = rows.select(*keys, F.col(vector).alias("__v")).select(*keys, "__v", F.posexplode("__v").alias("i", "__x"))
    two = one.select(*keys, "i", "__x", F.posexplode("__v").alias("j", "__y")).where("i <= j")
    x, y = F.col("__x").cast("double"), F.col("__y").cast("double")
    return two.groupBy(*keys, "i", "j").agg(F.count(F.when(x.isNotNull(), y)).alias("n"), F.covar_pop(x, y).alias("covariance"))


def mean_distance(rows: DataFrame, vector: str, order: list[Column], n: int = 512) -> DataFrame:
    """Mean Euclidean distance over all ordered pairs of at most n vectors, each with itself too."""
    some = rows.orderBy(*order).limit(n).agg(F.collect_list(F.transform(vector, lambda x: x.cast("double"))).alias("vs"))
    one = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d))
    total = F.aggregate("vs", F.lit(0.0), lambda s, a: s + F.aggregate("vs", F.lit(0.0), lambda r, b: r + one(a, b)))
    return some.select((total / (F.size("vs") * F.size("vs"))).alias("mean_distance"))
