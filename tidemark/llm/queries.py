"""The registered queries of the operators here, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, quality_crf
from .base import held_out, scratch, table
from .drake_kmeans import drake_kmeans
from .embedding_dedup import near_vectors
from .exact_dedup import exact_dedup
from .hpy_lm import hpy_scores
from .mixing import mix
from .packing import pack
from .phrases import collocations
from .sharding import ShardStore
from .simhash import near_duplicates
from .two_fit import pack_two_fit
from .url_filter import domains_of, filter_urls, host_of


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

#: Target size of a shard on disk, in bytes.
SHARD_BYTES = 4 << 20


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in two appends, are compacted, and are read back from the committed files."""
    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, scratch(spark, "shards"))
    store.append(docs.where("pmod(doc_id, 8) <> 0 or doc_id is null"))
    store.append(docs.where("pmod(doc_id, 8) = 0"))
    store.compact(docs.schema, SHARD_BYTES)
    store.expire()
    return store.read(docs.schema).select("doc_id", "source", F.octet_length("text").cast("long").alias("n_bytes"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


OP2_SQL = """
SELECT doc_id, source, strlen(text)::BIGINT AS n_bytes, md5(text) AS text_md5 FROM documents
"""


def _list_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the domains that occur: half of them are listed, some delisted, some listed again."""
    domains = pages.select(F.explode(domains_of(host_of(F.col("url")))).alias("domain")).distinct()
    n = F.conv(F.substring(F.md5(F.col("domain").cast("binary")), 1, 6), 16, 10).cast("long")
    day = lambda k: F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(k)
    first = (n % 60).cast("int")
    second = (n % 60 + 15 + n % 45).cast("int")
    third = (n % 60 + 70 + n % 31).cast("int")
    log = F.array(
        F.struct(day(first).alias("at"), F.lit(True).alias("listed"), F.lit(True).alias("real")),
        F.struct(day(second).alias("at"), F.lit(False).alias("listed"), (n % 3 != 0).alias("real")),
        F.struct(day(third).alias("at"), F.lit(True).alias("listed"), (n % 4 == 0).alias("real")),
    )
    return domains.where(n % 2 == 0).select("domain", F.explode(log).alias("e")).where("e.real").select("domain", "e.at", "e.listed")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    n = F.conv(F.substring(F.md5(F.col("url").cast("binary")), 1, 6), 16, 10).cast("long")
    fetched = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (n % 10368000).cast("decimal(18,6)"))
    return filter_urls(pages.withColumn("fetched", fetched), _list_entries(pages))


OP5_SQL = r"""
WITH p AS (
  SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.$', ''), '') AS host,
         TIMESTAMP '2024-01-01' + to_seconds((('0x' || substr(md5(url), 1, 6))::BIGINT % 10368000)::INTEGER) AS fetched
  FROM pages),
d AS (
  SELECT DISTINCT host, array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') AS domain
  FROM (SELECT host, unnest(range(1, greatest(len(string_split(host, '.')), 2))) AS i FROM (SELECT DISTINCT host FROM p WHERE host IS NOT NULL))),
n AS (SELECT domain, ('0x' || substr(md5(domain), 1, 6))::BIGINT AS n FROM (SELECT DISTINCT domain FROM d)),
e AS (
  SELECT domain, n % 60 AS day, true AS listed FROM n WHERE n % 2 = 0
  UNION ALL SELECT domain, n % 60 + 15 + n % 45, false FROM n WHERE n % 2 = 0 AND n % 3 <> 0
  UNION ALL SELECT domain, n % 60 + 70 + n % 31, true FROM n WHERE n % 2 = 0 AND n % 4 = 0),
u AS (SELECT domain, TIMESTAMP '2024-01-01' + to_days(day::INTEGER) AS at, bool_or(listed) AS listed FROM e GROUP BY ALL),
latest AS (
  SELECT p.page_id, p.fetched, d.domain, arg_max(u.listed, u.at) AS listed
  FROM p JOIN d USING (host) JOIN u ON u.domain = d.domain AND u.at <= p.fetched GROUP BY ALL)
SELECT p.page_id, p.host, p.fetched, x.domain AS blocked_by, x.domain IS NOT NULL AS blocked
FROM p LEFT JOIN (SELECT page_id, fetched, arg_max(domain, length(domain)) AS domain FROM latest WHERE listed GROUP BY ALL) x USING (page_id, fetched)
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('20240101:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
t AS (SELECT source, source_size, coalesce(least(cap, weight * (SELECT arg_min(level, cap / weight) FROM l WHERE level * weight <= cap)), cap) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
k AS (SELECT source, key, sum(size) AS size FROM d GROUP BY ALL),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key) AS upto FROM k)
SELECT d.doc_id, d.source, d.size, r.source_size, r.target,
       (d.size * (r.whole + CASE WHEN c.upto - c.size / 2.0::DOUBLE <= r.target - r.whole * r.source_size AND r.target > r.whole * r.source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN c ON c.source IS NOT DISTINCT FROM d.source AND c.key = d.key
"""


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpy_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs)
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id", language_id.FOLDS).alias("held_out"), "lang_pred", "score")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the contract's three words to a shingle; the operator's own default is five."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_crf.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = quality_crf.score(docs, model)
    return scored.select("doc_id", held_out("doc_id", quality_crf.FOLDS).alias("held_out"), "score", (F.col("score") >= quality_crf.THRESHOLD).cast("int").alias("predicted"))


def op11_drake_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drake_kmeans(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _kmeans_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """The rounds one after another: a vector's cluster and squared distance are read off the least distance * k + cluster."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT row_id, any_value(v) AS v, min(key) % {k} AS cluster, min(key) // {k} AS distance FROM (
    SELECT x.row_id, x.v, {k} * list_sum(list_transform(range(1, {dims + 1}), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))::BIGINT + c.cluster AS key FROM kept x CROSS JOIN c{r} c)
  GROUP BY row_id)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
      SELECT cluster, i, sum(v[i])::BIGINT AS s, count(*)::BIGINT AS n FROM a{r}, range(1, {dims + 1}) AS t(i) GROUP BY cluster, i)
    GROUP BY cluster) m USING (cluster))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dims}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v FROM (SELECT v, sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h FROM kept)
  ORDER BY h, v LIMIT {k}),
{", ".join(steps)}
SELECT vec_id, a.cluster::INTEGER AS cluster, distance::BIGINT AS distance, sum(distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia,
       sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM kept JOIN a{rounds} a USING (row_id) JOIN c{rounds} c ON c.cluster = a.cluster
"""


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP12_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS piece, lang, piece AS text FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
w AS (SELECT lang, regexp_extract_all(text, '[^\x20\x09]+') AS words FROM p),
g AS MATERIALIZED (
  SELECT lang, size, phrase, count(*)::BIGINT AS a FROM (
    SELECT lang, s.size, unnest(list_transform(range(1, len(words) - s.size + 2), lambda i: array_to_string(list_slice(words, i, i + s.size - 1), ' '))) AS phrase
    FROM w CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS size) s WHERE len(words) >= s.size)
  GROUP BY lang, size, phrase),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM g WHERE size = 1 GROUP BY lang),
f AS MATERIALIZED (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS words FROM g WHERE size > 1 AND a >= 100),
k AS (
  SELECT lang, phrase, size, a, k, array_to_string(list_slice(words, 1, k), ' ') AS lp, array_to_string(list_slice(words, k + 1, size), ' ') AS rp
  FROM (SELECT *, unnest(range(1, size)) AS k FROM f)),
s AS (
  SELECT k.lang, k.phrase, k.size, k.a, k.k, x.a AS l, y.a AS r, n.n, ((1000::HUGEINT * k.a * n.n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM k JOIN g x ON x.lang = k.lang AND x.phrase = k.lp JOIN g y ON y.lang = k.lang AND y.phrase = k.rp JOIN n ON n.lang = k.lang),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM s) WHERE nth = 1),
b AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN f ON f.lang = c.lang AND f.size > c.size AND 100 * f.a >= 100 * c.a AND contains(' ' || f.phrase || ' ', ' ' || c.phrase || ' '))
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY c.score DESC, c.a DESC, c.phrase) AS rank, c.phrase, c.a, c.l, c.r, c.n, c.score
  FROM c LEFT JOIN b ON b.lang = c.lang AND b.phrase = c.phrase WHERE b.phrase IS NULL)
WHERE rank <= 2000
"""


def op13_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_two_fit(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_sharding": op2_sharding,
        "op3_lm_scoring": op3_lm_scoring,
        "op4_packing": op4_packing,
        "op5_url_filter": op5_url_filter,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_language_id": op7_language_id,
        "op8_mixing": op8_mixing,
        "op9_simhash": op9_simhash,
        "op10_quality": op10_quality,
        "op11_drake_kmeans": op11_drake_kmeans,
        "op12_phrases": op12_phrases,
        "op13_two_fit": op13_two_fit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op2_sharding": OP2_SQL, "op5_url_filter": OP5_SQL, "op8_mixing": OP8_SQL, "op11_drake_kmeans": _kmeans_sql(), "op12_phrases": OP12_SQL}
