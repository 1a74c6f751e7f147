"""Every registered query with the SQL that gives the same rows.

Times are microseconds since the start of 2024 as the tables have them, without zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import axis, buckets, corpus, groups, harmony, notes, sampling, sequences, series, temporal
from ..sources import midi, musicxml
from ..streaming import feeds

HOUR = 3600
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query, and its SQL if SQL can express it."""
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f
    return put


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: str = "ts") -> Column:
    return F.unix_micros(F.col(c).cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").cast("timestamp"))


def events(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """event_id, user_id, event_type, value and t, whole seconds."""
    e = table(spark, sf_dir, "events")
    if kinds:
        e = e.where(F.col("event_type").isin(*kinds))
    return e.select("event_id", "user_id", "event_type", "value", F.floor(micros() / 1_000_000).cast("long").alias("t"))


#: The same in SQL, as the start of a WITH.
EV = """WITH ev AS (SELECT event_id, user_id, event_type, value, ((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000000)::BIGINT AS t FROM events)"""


def _sql(text: str) -> str:
    return text.replace("{EV}", EV)


# ---- buckets and statistics ---------------------------------------------------------------------------------

@query("bucket_dynamics", _sql("""{EV},
b AS (SELECT user_id, t // 21600 AS bucket, count(*) AS n, avg(value) AS mean FROM ev GROUP BY ALL),
s AS (SELECT user_id, unnest(generate_series(0, max(bucket))) AS bucket FROM b GROUP BY user_id),
f AS (SELECT user_id, bucket, coalesce(n, 0) AS n, ln(1 + coalesce(n, 0)) AS density, CASE WHEN n >= 3 THEN mean END AS loudness FROM s LEFT JOIN b USING (user_id, bucket)),
z AS (SELECT user_id, bucket, n,
  CASE WHEN count(density) OVER w >= 2 AND stddev_pop(density) OVER w > 1e-12::DOUBLE THEN round_even((density - avg(density) OVER w) / stddev_pop(density) OVER w, 6) END AS density_z,
  CASE WHEN count(loudness) OVER w >= 2 AND stddev_pop(loudness) OVER w > 1e-12::DOUBLE THEN round_even((loudness - avg(loudness) OVER w) / stddev_pop(loudness) OVER w, 6) END AS loudness_z
  FROM f WINDOW w AS (PARTITION BY user_id))
SELECT *, coalesce(floor((greatest(-3.0::DOUBLE, least(2.999999::DOUBLE, density_z)) + 3.0::DOUBLE) / 6.0::DOUBLE * 8)::INT + 1, 0) AS density_bin,
  CASE WHEN loudness_z IS NULL THEN 0 ELSE floor((greatest(-3.0::DOUBLE, least(2.999999::DOUBLE, loudness_z)) + 3.0::DOUBLE) / 6.0::DOUBLE * 8)::INT + 1 END AS loudness_bin FROM z""").replace("coalesce(floor((greatest(-3.0::DOUBLE, least(2.999999::DOUBLE, density_z)) + 3.0::DOUBLE) / 6.0::DOUBLE * 8)::INT + 1, 0)", "CASE WHEN density_z IS NULL THEN 0 ELSE floor((greatest(-3.0::DOUBLE, least(2.999999::DOUBLE, density_z)) + 3.0::DOUBLE) / 6.0::DOUBLE * 8)::INT + 1 END"))
def bucket_dynamics(spark, sf_dir):
    return buckets.bucket_dynamics(events(spark, sf_dir), ["user_id"], "t", "value", 6 * HOUR)


@query("sample_stats", _sql("""{EV}
SELECT user_id, count(*) AS n, round_even(count(*) / greatest(max(t + 60) - min(t), 1), 9) AS rate, round_even(count(*) / count(DISTINCT t), 6) AS per_onset,
  round_even(avg(length(event_type)), 6) AS pitch_mean, round_even(stddev_pop(length(event_type)), 6) AS pitch_std, round_even(avg(value), 6) AS velocity_mean, 60.0::DOUBLE AS duration_median
FROM ev GROUP BY user_id"""))
def sample_stats(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("pitch", F.length("event_type")).withColumn("duration", F.lit(60))
    s = buckets.sample_stats(e, ["user_id"], "t", "pitch", "value", "duration")
    return s.select("user_id", "n", F.bround("rate", 9).alias("rate"), *[F.bround(c, 6).alias(c) for c in ("per_onset", "pitch_mean", "pitch_std", "velocity_mean")], "duration_median")


@query("price_percentiles", """SELECT o_orderpriority, round_even(quantile_cont(o_totalprice, 0.05), 6) AS p05, round_even(quantile_cont(o_totalprice, 0.5), 6) AS p50,
  round_even(quantile_cont(o_totalprice, 0.95), 6) AS p95, round_even(quantile_cont(o_totalprice, 0.95) - quantile_cont(o_totalprice, 0.05), 6) AS span FROM orders GROUP BY ALL""")
def price_percentiles(spark, sf_dir):
    p = F.percentile("o_totalprice", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    g = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(p.alias("p"))
    return g.select("o_orderpriority", *[F.bround(F.get("p", F.lit(i)), 6).alias(n) for i, n in enumerate(("p05", "p50", "p95"))], F.bround(F.get("p", F.lit(2)) - F.get("p", F.lit(0)), 6).alias("span"))


@query("sync_metrics", _sql("""{EV},
r0 AS (SELECT DISTINCT user_id, t FROM ev WHERE event_type = 'view'),
r AS (SELECT * FROM r0 WHERE user_id IN (SELECT user_id FROM r0 GROUP BY user_id HAVING count(*) >= 2)),
g AS (SELECT DISTINCT user_id, t FROM ev WHERE event_type = 'click' AND user_id IN (SELECT user_id FROM r)),
n AS (SELECT g.user_id, g.t, p.t AS pt, q.t AS qt FROM g ASOF LEFT JOIN r p ON g.user_id = p.user_id AND g.t >= p.t ASOF LEFT JOIN r q ON g.user_id = q.user_id AND g.t < q.t),
d AS (SELECT user_id, t, t - CASE WHEN qt IS NOT NULL AND (pt IS NULL OR qt - t < t - pt) THEN qt ELSE pt END AS off FROM n),
b AS (SELECT user_id, t // 432000 AS bin, quantile_cont(off, 0.5) AS m FROM d GROUP BY ALL HAVING count(*) >= 3),
s AS (SELECT user_id, CASE WHEN count(*) >= 2 THEN stddev_pop(m) END AS drift_std FROM b GROUP BY user_id)
SELECT d.user_id, count(*) AS n, round_even(avg(CASE WHEN abs(off) <= 1800 THEN 1.0::DOUBLE ELSE 0 END), 6) AS onset_sync, quantile_cont(off, 0.5)::DOUBLE AS offset_median, round_even(any_value(drift_std), 6) AS drift_std
FROM d LEFT JOIN s USING (user_id) GROUP BY d.user_id"""))
def sync_metrics(spark, sf_dir):
    s = buckets.sync_metrics(events(spark, sf_dir, "view"), events(spark, sf_dir, "click"), ["user_id"], "t", 1800, 5 * 86400, 3)
    return s.select("user_id", "n", F.bround("onset_sync", 6).alias("onset_sync"), "offset_median", F.bround("drift_std", 6).alias("drift_std"))


@query("set_f1", """WITH a AS (SELECT o_orderpriority, o_orderkey FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT DISTINCT o_orderpriority, o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'),
j AS (SELECT o_orderpriority, o_orderkey, a.o_orderkey IS NOT NULL AS x, b.o_orderkey IS NOT NULL AS y FROM a FULL JOIN b USING (o_orderpriority, o_orderkey))
SELECT o_orderpriority, count(*) FILTER (x) AS n_a, count(*) FILTER (y) AS n_b, count(*) FILTER (x AND y) AS hit, round_even(2.0::DOUBLE * count(*) FILTER (x AND y) / (count(*) FILTER (x) + count(*) FILTER (y)), 9) AS f1 FROM j GROUP BY ALL""")
def set_f1(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    a = o.where("o_orderstatus = 'F'")
    b = o.join(l.where("l_returnflag = 'R'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return buckets.set_f1(a, b, ["o_orderpriority"], ["o_orderkey"]).withColumn("f1", F.bround("f1", 9))


@query("multiset_overlap", """WITH a AS (SELECT l_linestatus, l_quantity::BIGINT AS pos, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' OR l_linestatus = 'O' GROUP BY ALL),
b AS (SELECT l_linestatus, l_quantity::BIGINT AS pos, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' OR l_linestatus = 'O' GROUP BY ALL),
s AS (SELECT a.l_linestatus, s.shift::INT AS shift, sum(least(a.n, b.n))::BIGINT AS overlap FROM b, (SELECT unnest(generate_series(-8, 8)) AS shift) s, a WHERE a.l_linestatus = b.l_linestatus AND a.pos = b.pos + s.shift GROUP BY ALL)
SELECT l_linestatus, shift, overlap FROM s QUALIFY row_number() OVER (PARTITION BY l_linestatus ORDER BY overlap DESC, abs(shift), shift) = 1""")
def multiset_overlap(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_returnflag", F.col("l_quantity").cast("long").alias("pos"))
    return buckets.multiset_shift(l.where("l_returnflag = 'R' or l_linestatus = 'O'"), l.where("l_returnflag = 'A' or l_linestatus = 'O'"), ["l_linestatus"], "pos", [], list(range(-8, 9)))


@query("group_share_rare", """WITH s AS (SELECT l_returnflag, l_linestatus, count(*) / (SELECT count(*) FROM lineitem) < 0.24 AS rare FROM lineitem GROUP BY ALL),
r AS (SELECT l_orderkey, bool_or(rare) AS any_rare FROM lineitem JOIN s USING (l_returnflag, l_linestatus) GROUP BY ALL),
c AS (SELECT l_orderkey, coalesce(l_returnflag <> lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey), false) AS c FROM lineitem)
SELECT l_orderkey, any_rare, n_changes FROM r JOIN (SELECT l_orderkey, count(*) FILTER (c) AS n_changes FROM c GROUP BY ALL) USING (l_orderkey)""")
def group_share_rare(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    rare = buckets.rare_share(l, ["l_orderkey"], ["l_returnflag", "l_linestatus"], 0.24)
    return rare.join(series.changes(l, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "l_returnflag"), "l_orderkey")


@query("token_histogram", """SELECT v.l_quantity::INT AS quantity, count(l.l_quantity) AS n FROM (SELECT unnest(generate_series(0, 60)) AS l_quantity) v LEFT JOIN lineitem l ON l.l_quantity = v.l_quantity GROUP BY ALL""")
def token_histogram(spark, sf_dir):
    vocabulary = spark.range(61).select(F.col("id").cast("int").alias("quantity"))
    return buckets.histogram(table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").alias("quantity")), "quantity", vocabulary)


@query("star_summary", """SELECT r_name, n_name, count(*) AS n_orders, round_even(sum(o_totalprice), 2) AS total, count(DISTINCT c_custkey) AS n_customers
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def star_summary(spark, sf_dir):
    o, c, n, r = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation", "region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("n_orders"), F.bround(F.sum("o_totalprice"), 2).alias("total"), F.countDistinct("c_custkey").alias("n_customers"))


# ---- temporal joins -----------------------------------------------------------------------------------------

@query("clip_to_next", _sql("""{EV}, d AS (SELECT event_id, user_id, event_type, t, greatest(1, round_even(value * 600, 0)::BIGINT) AS d, lead(t) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS nx FROM ev)
SELECT event_id, user_id, event_type, t, CASE WHEN t + d > nx THEN greatest(1, nx - t) ELSE d END AS duration FROM d"""))
def clip_to_next(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("duration", F.greatest(F.lit(1), F.rint(F.col("value") * 600).cast("long"))).drop("value")
    return temporal.clip_to_next(e, ["user_id", "event_type"], "t", "duration", ["event_id"])


@query("merge_intervals", _sql("""{EV}, i AS (SELECT user_id, t AS start, greatest(t + 1, t + round_even(value * 60, 0)::BIGINT) AS stop FROM ev),
m AS (SELECT *, max(stop) OVER (PARTITION BY user_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, min(start) AS start, max(stop) AS stop FROM g GROUP BY user_id, island"""))
def merge_intervals(spark, sf_dir):
    spans = events(spark, sf_dir).select("user_id", F.col("t").alias("start"), F.greatest(F.col("t") + 1, F.col("t") + F.rint(F.col("value") * 60).cast("long")).alias("stop"))
    return temporal.merge_intervals(spans, ["user_id"], "start", "stop")


def _toggles(spark, sf_dir):
    e = events(spark, sf_dir, "signup", "error").withColumn("on", F.col("event_type") == "signup")
    return temporal.toggle_intervals(e, ["user_id"], "t", "on", F.lit(31 * 86400).cast("long"), ["event_id"])


_TOGGLE = """{EV}, c AS (SELECT *, event_type = 'signup' AS is_on, lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS was FROM ev WHERE event_type IN ('signup', 'error')),
f AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS nx FROM c WHERE CASE WHEN was IS NULL THEN is_on ELSE was <> event_type END),
spans AS (SELECT user_id, t AS start, coalesce(nx, 2678400) AS stop FROM f WHERE is_on)"""


@query("toggle_intervals", _sql(_TOGGLE + " SELECT * FROM spans"))
def toggle_intervals(spark, sf_dir):
    return _toggles(spark, sf_dir)


@query("interval_containment", _sql(_TOGGLE + """, p AS (SELECT event_id, user_id, t FROM ev WHERE event_type = 'click')
SELECT p.event_id, p.user_id, p.t, s.start, s.stop FROM p LEFT JOIN spans s ON p.user_id = s.user_id AND s.start <= p.t AND p.t < s.stop"""))
def interval_containment(spark, sf_dir):
    return temporal.containing(events(spark, sf_dir, "click").select("event_id", "user_id", "t"), _toggles(spark, sf_dir), ["user_id"], "t", "start", "stop")


@query("asof_state", _sql("""{EV}, s AS (SELECT user_id, t, arg_max(value, event_id) AS value FROM ev WHERE event_type = 'purchase' GROUP BY ALL)
SELECT p.event_id, p.user_id, p.t, s.value AS value_asof, s.t AS t_asof FROM (SELECT event_id, user_id, t FROM ev WHERE event_type = 'click') p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.t > s.t"""))
def asof_state(spark, sf_dir):
    state = events(spark, sf_dir, "purchase").groupBy("user_id", "t").agg(F.max_by("value", "event_id").alias("value"))
    return temporal.asof_join(events(spark, sf_dir, "click").select("event_id", "user_id", "t"), state, ["user_id"], "t", ["value"])


@query("nearest_event", _sql("""{EV}, s AS (SELECT user_id, t, min(event_id) AS near FROM ev WHERE event_type = 'purchase' GROUP BY ALL),
n AS (SELECT c.event_id, c.user_id, c.t, p.t AS pt, p.near AS pn, q.t AS qt, q.near AS qn FROM (SELECT event_id, user_id, t FROM ev WHERE event_type = 'click') c ASOF LEFT JOIN s p ON c.user_id = p.user_id AND c.t >= p.t ASOF LEFT JOIN s q ON c.user_id = q.user_id AND c.t < q.t),
k AS (SELECT *, qt IS NOT NULL AND (pt IS NULL OR qt - t < t - pt) AS later FROM n)
SELECT event_id, user_id, t, CASE WHEN later THEN qn ELSE pn END AS near_near, CASE WHEN later THEN qt ELSE pt END AS t_near, abs(CASE WHEN later THEN qt ELSE pt END - t) AS distance FROM k"""))
def nearest_event(spark, sf_dir):
    target = events(spark, sf_dir, "purchase").groupBy("user_id", "t").agg(F.min("event_id").alias("near"))
    return temporal.nearest_join(events(spark, sf_dir, "click").select("event_id", "user_id", "t"), target, ["user_id"], "t", ["near"])


def _knots(spark, sf_dir):
    return events(spark, sf_dir, "purchase").groupBy("user_id", "t").agg(F.max("value").alias("y"))


_INTERP = """{EV}, k0 AS (SELECT user_id, t, max(value) AS y FROM ev WHERE event_type = 'purchase' GROUP BY ALL),
k AS (SELECT user_id, t, y, lead(t) OVER w AS nt, lead(y) OVER w AS ny, lag(t) OVER w AS pt, lag(y) OVER w AS py, row_number() OVER w AS rn FROM k0 WINDOW w AS (PARTITION BY user_id ORDER BY t)),
s AS (SELECT *, CASE WHEN nt IS NOT NULL THEN (ny - y) / (nt - t) ELSE {LAST} END AS slope FROM k),
p AS (SELECT event_id, user_id, t FROM ev WHERE event_type = 'click'),
j AS (SELECT p.*, s.t AS kt, s.y AS ky, s.slope, h.t AS ht, h.y AS hy, h.slope AS hs FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.t >= s.t LEFT JOIN s h ON h.user_id = p.user_id AND h.rn = 1)
SELECT event_id, user_id, t, round_even(CASE WHEN kt IS NULL THEN hy {HEAD} ELSE ky + (t - kt) * coalesce(slope, 0) END, 6) AS y_at FROM j"""


@query("interp_align", _sql(_INTERP.replace("{LAST}", "0").replace("{HEAD}", "")))
def interp_align(spark, sf_dir):
    out = temporal.interp_join(events(spark, sf_dir, "click").select("event_id", "user_id", "t"), _knots(spark, sf_dir), ["user_id"], "t", "y")
    return out.withColumn("y_at", F.bround("y_at", 6))


@query("extrapolate_align", _sql(_INTERP.replace("{LAST}", "(y - py) / (t - pt)").replace("{HEAD}", "+ (t - ht) * coalesce(hs, 0)")))
def extrapolate_align(spark, sf_dir):
    out = temporal.interp_join(events(spark, sf_dir, "click").select("event_id", "user_id", "t"), _knots(spark, sf_dir), ["user_id"], "t", "y", extrapolate=True)
    return out.withColumn("y_at", F.bround("y_at", 6))


@query("band_match", _sql("""{EV} SELECT p.event_id, count(v.event_id) AS n, max(v.value) AS top FROM (SELECT * FROM ev WHERE event_type = 'click') p LEFT JOIN (SELECT * FROM ev WHERE event_type = 'view') v ON p.user_id = v.user_id AND abs(p.t - v.t) <= 7200 GROUP BY p.event_id"""))
def band_match(spark, sf_dir):
    views = events(spark, sf_dir, "view").select("user_id", "t", F.col("event_id").alias("other"), F.col("value").alias("v"))
    pairs = temporal.band_join(events(spark, sf_dir, "click").select("event_id", "user_id", "t"), views, ["user_id"], "t", 7200, ["other", "v"])
    return pairs.groupBy("event_id").agg(F.count("other").alias("n"), F.max("v").alias("top"))


@query("lag_search", _sql("""{EV}, p AS (SELECT DISTINCT user_id, t // 3600 AS h FROM ev WHERE event_type = 'click'), q AS (SELECT DISTINCT user_id, t // 3600 AS h FROM ev WHERE event_type = 'view'),
l AS (SELECT user_id, unnest(generate_series(-5, 5)) AS lag FROM (SELECT DISTINCT user_id FROM p)),
c AS (SELECT l.user_id, l.lag, count(DISTINCT CASE WHEN q.h IS NOT NULL THEN p.h END) AS hits FROM l JOIN p USING (user_id) LEFT JOIN q ON q.user_id = l.user_id AND q.h = p.h + l.lag GROUP BY ALL)
SELECT user_id, lag, hits FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY hits DESC, lag) = 1"""))
def lag_search(spark, sf_dir):
    hours = lambda kind: events(spark, sf_dir, kind).select("user_id", F.floor(F.col("t") / HOUR).cast("long").alias("h"))
    counts = temporal.lag_search(hours("click"), hours("view"), ["user_id"], "h", -5, 5)
    return temporal.best_by(counts, ["user_id"], "hits", [F.col("lag")], ["lag"])


@query("sessionise", _sql("""{EV}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 3600 THEN 1 ELSE 0 END AS new FROM ev),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g)
SELECT user_id, session, min(t) AS start, max(t) AS stop, count(*) AS n FROM s GROUP BY ALL"""))
def sessionise(spark, sf_dir):
    return temporal.sessions(events(spark, sf_dir), ["user_id"], "t", HOUR, ["event_id"])


@query("runs", _sql("""{EV}, n AS (SELECT user_id, value > 20 AS flag, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS n FROM ev),
i AS (SELECT *, n - row_number() OVER (PARTITION BY user_id ORDER BY n) AS island FROM n WHERE flag)
SELECT user_id, min(n) AS first, max(n) AS last, count(*) AS length FROM i GROUP BY user_id, island HAVING count(*) >= 3"""))
def runs(spark, sf_dir):
    return temporal.runs(events(spark, sf_dir).withColumn("flag", F.col("value") > 20).select("user_id", "t", "event_id", "flag"), ["user_id"], ["t", "event_id"], "flag", 3).select("user_id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "length")


# ---- series -------------------------------------------------------------------------------------------------

def _daily(spark, sf_dir):
    """event_type, day, n, m (mean in whole hundredths, rounded down) and mean (the same, null on some days)."""
    d = events(spark, sf_dir).groupBy("event_type", F.floor(F.col("t") / 86400).cast("long").alias("day")).agg(F.count("*").alias("n"), F.floor(F.sum(F.rint(F.col("value") * 100).cast("long")) / F.count("*")).cast("double").alias("m"))
    return d.withColumn("mean", F.when(F.pmod("n", F.lit(5)) != 0, F.col("m")))


DAILY = _sql("""{EV}, daily AS (SELECT event_type, t // 86400 AS day, count(*) AS n, floor(sum(round_even(value * 100, 0)::BIGINT) / count(*))::DOUBLE AS m, CASE WHEN count(*) % 5 <> 0 THEN floor(sum(round_even(value * 100, 0)::BIGINT) / count(*))::DOUBLE END AS mean FROM ev GROUP BY ALL)""")


@query("moving_avg_null_aware", DAILY + """ SELECT event_type, day, round_even(CASE WHEN mean IS NOT NULL THEN avg(mean) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END, 6) AS smooth FROM daily""")
def moving_avg_null_aware(spark, sf_dir):
    return series.smooth(_daily(spark, sf_dir), ["event_type"], ["day"], "mean", 2, "smooth").select("event_type", "day", F.bround("smooth", 6).alias("smooth"))


@query("reflected_average", DAILY + """, e AS (SELECT event_type, list(m ORDER BY day) AS xs, list(day ORDER BY day) AS days FROM daily GROUP BY ALL),
i AS (SELECT event_type, days[j + 1] AS day, j, k, xs, len(xs) AS n FROM e, (SELECT unnest(generate_series(0, 400)) AS j), (SELECT unnest(generate_series(-2, 1)) AS k) WHERE j < len(xs)),
v AS (SELECT event_type, day, CASE WHEN j + k < 0 THEN 2 * xs[1] - xs[least(-(j + k), n - 1) + 1] WHEN j + k >= n THEN 2 * xs[n] - xs[greatest(2 * (n - 1) - (j + k), 0) + 1] ELSE xs[j + k + 1] END AS x FROM i)
SELECT event_type, day, round_even(sum(x) / 4, 6) AS smooth FROM v GROUP BY ALL""")
def reflected_average(spark, sf_dir):
    d = _daily(spark, sf_dir).select("event_type", "day", "m")
    return series.reflect_mean(d, ["event_type"], ["day"], "m", 4, "smooth").select("event_type", "day", F.bround("smooth", 6).alias("smooth"))


@query("rolling_median", DAILY + """ SELECT event_type, day, list_sort([coalesce(lag(m) OVER w, m), m, coalesce(lead(m) OVER w, m)])[2] AS median FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY day)""")
def rolling_median(spark, sf_dir):
    return series.rolling_median(_daily(spark, sf_dir), ["event_type"], ["day"], "m", 1, "median").select("event_type", "day", "median")


@query("majority_vote", DAILY + """, l AS (SELECT event_type, day, (n % 3)::INT AS level FROM daily),
c AS (SELECT event_type, day, level, count(*) FILTER (level = 0) OVER w AS a, count(*) FILTER (level = 1) OVER w AS b, count(*) FILTER (level = 2) OVER w AS c FROM l WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING))
SELECT event_type, day, level, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS voted FROM c""")
def majority_vote(spark, sf_dir):
    d = _daily(spark, sf_dir).select("event_type", "day", F.pmod("n", F.lit(3)).cast("int").alias("level"))
    return series.majority(d, ["event_type"], ["day"], "level", [0, 1, 2], 4, "voted")


@query("fold_monotone", DAILY + """, k AS (SELECT event_type, day, n, max(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM daily) SELECT event_type, day, n FROM k WHERE top IS NULL OR n > top""")
def fold_monotone(spark, sf_dir):
    return series.rising(_daily(spark, sf_dir).select("event_type", "day", "n"), ["event_type"], ["day"], "n")


@query("drop_repeats", _sql("""{EV}, w AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS was FROM ev) SELECT event_id, user_id, event_type FROM w WHERE was IS NULL OR was <> event_type"""))
def drop_repeats(spark, sf_dir):
    return series.drop_repeats(events(spark, sf_dir), ["user_id"], ["t", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query("thin_evenly", _sql("""{EV}, r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS c FROM ev)
SELECT event_id, user_id FROM r WHERE c <= 20 OR r = 0 OR (r * 20) // c <> ((r - 1) * 20) // c"""))
def thin_evenly(spark, sf_dir):
    return series.thin(events(spark, sf_dir), ["user_id"], ["t", "event_id"], 20).select("event_id", "user_id")


@query("tempo_segments", DAILY.replace("WITH ", "WITH RECURSIVE ", 1) + """,
s AS (SELECT event_type, day, m, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i FROM daily),
r AS (SELECT event_type, i, 0 AS segment, [m] AS xs FROM s WHERE i = 1
  UNION ALL SELECT s.event_type, s.i, CASE WHEN abs(s.m / list_aggregate(r.xs, 'median') - 1) <= 0.05::DOUBLE THEN r.segment ELSE r.segment + 1 END, CASE WHEN abs(s.m / list_aggregate(r.xs, 'median') - 1) <= 0.05::DOUBLE THEN list_append(r.xs, s.m) ELSE [s.m] END
  FROM r JOIN s ON s.event_type = r.event_type AND s.i = r.i + 1)
SELECT event_type, segment, (min(i) - 1)::INTEGER AS first, count(*)::INTEGER AS n, list_aggregate(arg_max(xs, i), 'median') AS value FROM r GROUP BY event_type, segment""")
def tempo_segments(spark, sf_dir):
    return series.tempo_segments(_daily(spark, sf_dir).select("event_type", "day", "m"), ["event_type"], "day", "m")


@query("repedal", _sql("""{EV}, p AS (SELECT user_id, t // 600 AS a, t // 600 + round_even(value, 0)::BIGINT AS b FROM ev),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a, b) AS n FROM p),
s AS (SELECT user_id, n, b, max(a - n) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) + n AS start FROM n)
SELECT user_id, start AS "on", least(greatest(b, start + 1), lead(start) OVER (PARTITION BY user_id ORDER BY n)) AS "off" FROM s"""))
def repedal(spark, sf_dir):
    spans = events(spark, sf_dir).select("user_id", F.floor(F.col("t") / 600).cast("long").alias("on"), (F.floor(F.col("t") / 600) + F.rint("value")).cast("long").alias("off"))
    return series.repedal(spans, ["user_id"], "on", "off")


@query("duration_bins", """WITH b AS (SELECT event_id, value, [{BOUNDS}]::DOUBLE[] AS bounds FROM events) SELECT event_id, len(list_filter(bounds, lambda x: x < value))::INT AS bin FROM b""".replace("{BOUNDS}", ", ".join(map(repr, scalar.bounds_of(scalar.duration_values())))))
def duration_bins(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalar.bin_of(F.col("value"), scalar.bounds_of(scalar.duration_values())).alias("bin"))


# ---- corpora ------------------------------------------------------------------------------------------------

@query("ngram_containment", r"""WITH q AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9à-ÿß]+'), lambda w: w <> '') AS w FROM benchmark),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9à-ÿß]+'), lambda w: w <> '') AS w FROM documents),
qg AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM q WHERE len(w) >= 5)),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
n AS (SELECT item_id, count(*) AS size FROM qg GROUP BY ALL)
SELECT item_id, doc_id, count(*) AS shared, round_even(count(*) / any_value(size), 9) AS containment FROM qg JOIN dg USING (gram) JOIN n USING (item_id) GROUP BY ALL HAVING count(*) / any_value(size) >= 0.2::DOUBLE""")
def ngram_containment(spark, sf_dir):
    found = corpus.containment_of(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id", "text", 5, 0.2)
    return found.select("item_id", "doc_id", "shared", F.bround("containment", 9).alias("containment"))


@query("quality_lint", r"""WITH n AS (SELECT doc_id, greatest(length(text), 1) AS n, text FROM documents),
r AS (SELECT doc_id, round_even(len(regexp_extract_all(text, '\|')) / n, 6) AS bar_rate, round_even(len(regexp_extract_all(text, '[A-Z]')) / n, 6) AS upper_rate, round_even(len(regexp_extract_all(text, '[$%&*#]')) / n, 6) AS sign_rate, round_even(len(regexp_extract_all(text, '[0-9]')) / n, 6) AS digit_rate FROM n)
SELECT r.*, (bar_rate > 0.02 OR upper_rate > 0.5 OR sign_rate > 0.05 OR digit_rate > 0.2) AS low_quality, l.quality FROM r LEFT JOIN labels l USING (doc_id)""")
def quality_lint(spark, sf_dir):
    return corpus.lint(table(spark, sf_dir, "documents"), ["doc_id"], "text").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("hash_split", """SELECT doc_id, CASE WHEN b < 5 THEN 1 WHEN b < 10 THEN 2 ELSE 0 END AS split FROM (SELECT doc_id, (('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 10000) / 100.0::DOUBLE AS b FROM documents)""")
def hash_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", corpus.md5_split_of(F.col("doc_id"), 5.0, 5.0).alias("split"))


@query("anti_leak", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_leak(spark, sf_dir):
    return corpus.exclude(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("dedupe_keep_longest", _sql("""{EV} SELECT user_id, t // 86400 AS day, event_type, event_id, value FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, t // 86400, event_type ORDER BY value DESC, event_id) = 1"""))
def dedupe_keep_longest(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", F.floor(F.col("t") / 86400).cast("long").alias("day"), "event_type", "event_id", "value")
    return corpus.dedupe_longest(e, ["user_id", "day", "event_type"], "value", [F.col("event_id")])


@query("latest_wins", "SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1")
def latest_wins(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return corpus.latest(c, ["conv_id"], ["turn", "role", "text"])


@query("stable_ids", """WITH k AS (SELECT c_name, row_number() OVER (ORDER BY c_name) AS id FROM customer WHERE c_custkey % 3 = 0),
n AS (SELECT DISTINCT c_name FROM customer WHERE c_name NOT IN (SELECT c_name FROM k))
SELECT c_name, id FROM k UNION ALL SELECT c_name, (SELECT max(id) FROM k) + row_number() OVER (ORDER BY c_name) FROM n""")
def stable_ids(spark, sf_dir):
    from ..operators.ranks import global_rank

    c = table(spark, sf_dir, "customer")
    known = global_rank(c.where("c_custkey % 3 = 0").select("c_name"), ["c_name"], "id")
    return corpus.stable_ids(known, c, "c_name", "id")


@query("pipeline_error_split", """SELECT CASE WHEN l_quantity < 5 THEN 'short' WHEN l_discount > 0.08 THEN 'discounted' ELSE 'late' END AS reason, count(*) AS n FROM lineitem WHERE l_quantity < 5 OR l_discount > 0.08 OR l_shipdate >= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pipeline_error_split(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    reasons = {"short": F.col("l_quantity") < 5, "discounted": F.col("l_discount") > 0.08, "late": F.col("l_shipdate") >= F.lit("1998-09-02").cast("timestamp_ntz")}
    return corpus.reject_reasons(l, reasons)[1]


@query("prefer_first", """WITH a AS (SELECT o_custkey, max(o_totalprice) AS p FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL), b AS (SELECT o_custkey, max(o_totalprice) AS p FROM orders GROUP BY ALL)
SELECT c_custkey, coalesce(a.p, b.p) AS p FROM customer LEFT JOIN a ON a.o_custkey = c_custkey LEFT JOIN b ON b.o_custkey = c_custkey""")
def prefer_first(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    top = lambda d: d.groupBy("c_custkey").agg(F.max("o_totalprice").alias("p"))
    return corpus.prefer(table(spark, sf_dir, "customer").select("c_custkey"), top(o.where("o_orderpriority = '1-URGENT'")), top(o), ["c_custkey"], ["p"])


@query("sparse_override", """SELECT d.doc_id, coalesce(CASE WHEN l.doc_id IS NOT NULL THEN 'labelled' END, d.source) AS source FROM documents d LEFT JOIN labels l USING (doc_id)""")
def sparse_override(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return corpus.override(d, table(spark, sf_dir, "labels").select("doc_id", F.lit("labelled").alias("source")), ["doc_id"], ["source"])


@query("first_per_group", "SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_per_group(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return o.groupBy("o_custkey").agg(F.min_by(F.struct("o_orderkey", "o_orderdate"), F.struct("o_orderdate", "o_orderkey")).alias("r")).select("o_custkey", "r.*")


@query("vector_project", "SELECT label, (generate_subscripts(embedding, 1) - 1)::INT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings".join(["WITH c AS (", ") SELECT label, dim, count(x) AS n, round_even(avg(x), 6) AS mean, round_even(var_pop(x), 6) AS variance FROM c GROUP BY ALL"]))
def vector_project(spark, sf_dir):
    m = corpus.vector_moments(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return m.select("label", "dim", "n", F.bround("mean", 6).alias("mean"), F.bround("variance", 6).alias("variance"))


@query("pairwise_distance_mean", """WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings ORDER BY md5(vec_id::VARCHAR), vec_id LIMIT 512) SELECT round_even(sum(list_distance(a.v, b.v)) / (count(*)), 6) AS mean_distance FROM s a, s b""")
def pairwise_distance_mean(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    d = corpus.mean_distance(e, "embedding", [F.md5(F.col("vec_id").cast("string").cast("binary")), F.col("vec_id")])
    return d.select(F.bround("mean_distance", 6).alias("mean_distance"))


@query("xml_scan", r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a\s[^>]*href='))::INT AS n_links, len(regexp_extract_all(html, '<p[\s>]'))::INT AS n_paragraphs, nullif(regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1), '') AS lang FROM pages""")
def xml_scan(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count(h, F.lit(r"<a\s[^>]*href=")).alias("n_links"),
        F.regexp_count(h, F.lit(r"<p[\s>]")).alias("n_paragraphs"), F.nullif(F.regexp_extract(h, '<html[^>]*lang="([^"]*)"', 1), F.lit("")).alias("lang"),
    )


# ---- sampling -----------------------------------------------------------------------------------------------

@query("length_damped_weights", """WITH t AS (SELECT source, sum(n_chars) AS total FROM documents GROUP BY ALL) SELECT doc_id, source, round_even(n_chars * power(greatest(total, 100000.0::DOUBLE) / 100000.0::DOUBLE, -0.5::DOUBLE), 6) AS weight FROM documents JOIN t USING (source)""")
def length_damped_weights(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return sampling.damped_weights(d, "n_chars", "source", 100_000.0, 0.5).select("doc_id", "source", F.bround("weight", 6).alias("weight"))


@query("top_p", """WITH w AS (SELECT p_brand, p_partkey, p_retailprice, coalesce(sum(p_retailprice::DECIMAL(18,2)) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(p_retailprice::DECIMAL(18,2)) OVER (PARTITION BY p_brand) AS s FROM part) SELECT p_brand, p_partkey FROM w WHERE b::DOUBLE / s::DOUBLE <= 0.5""")
def top_p(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_retailprice").cast("decimal(18,2)").cast("double").alias("w"))
    return sampling.top_p(p, ["p_brand"], "w", ["p_partkey"], 0.5).select("p_brand", "p_partkey")


@query("window_starts", """SELECT doc_id, floor((('0x' || substr(md5('3|' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE) * greatest(n_chars - 200 + 1, 1))::BIGINT AS start FROM documents""")
def window_starts(spark, sf_dir):
    return sampling.window_starts(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 200, 3).select("doc_id", "start")


# ---- sequences ----------------------------------------------------------------------------------------------

def _notes(spark, sf_dir):
    """Events as a note table: signups and errors switch a pedal, the others are notes."""
    kind = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "signup", 1).otherwise(2)
    note = kind == 2
    return events(spark, sf_dir).select(
        "user_id", F.floor(F.col("t") / 60).cast("long").alias("onset"), kind.alias("kind"),
        F.when(note, F.length("event_type") + 60).otherwise(0).cast("long").alias("pitch"),
        F.when(note, F.greatest(F.lit(1), F.rint("value"))).otherwise(0).cast("long").alias("duration"), F.when(note, F.pmod("event_id", F.lit(127)) + 1).otherwise(0).cast("long").alias("velocity"),
    )


@query("token_round_trip", _sql("""{EV}, n AS (SELECT user_id, t // 60 AS onset, CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END AS kind, event_type, value, event_id FROM ev)
SELECT user_id, onset, kind, CASE WHEN kind = 2 THEN length(event_type) + 60 ELSE 0 END::BIGINT AS pitch, CASE WHEN kind = 2 THEN least(1024, greatest(1, round_even(value, 0))) ELSE 0 END::BIGINT AS duration, CASE WHEN kind = 2 THEN event_id % 127 + 1 ELSE 0 END::BIGINT AS velocity FROM n"""))
def token_round_trip(spark, sf_dir):
    return sequences.detokenise(sequences.tokenise(_notes(spark, sf_dir), ["user_id"], 1440), ["user_id"], 1440)


@query("pair_segments", """WITH n AS (SELECT conv_id, turn, length(text) >= 60 AS ok, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations),
r AS (SELECT *, n - row_number() OVER (PARTITION BY conv_id ORDER BY n) AS run FROM n WHERE ok),
s AS (SELECT conv_id, turn, n, min(n) OVER w AS segment, count(*) OVER w AS segment_rows FROM r WINDOW w AS (PARTITION BY conv_id, run))
SELECT conv_id, turn, segment, segment_rows, n - segment AS position FROM s WHERE segment_rows >= 2""")
def pair_segments(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return sequences.segments(c, ["conv_id"], "turn", F.length("text") >= 60, 2).select("conv_id", "turn", F.col("segment").cast("long").alias("segment"), "segment_rows", F.col("position").cast("long").alias("position"))


# ---- streams ------------------------------------------------------------------------------------------------

def _stream(spark, sf_dir):
    return feeds.read_events(spark, f"{sf_dir}/events*.parquet")


def _seconds(c: str) -> Column:
    return (F.unix_seconds(c) - 1704067200).alias(c)


@query("stream_tumbling", _sql("""{EV} SELECT event_type, t // 21600 * 21600 AS start, count(*) AS n, round_even(sum(value), 4) AS total FROM ev GROUP BY ALL"""))
def stream_tumbling(spark, sf_dir):
    out = feeds.table_of(feeds.tumbling(_stream(spark, sf_dir), ["event_type"], "6 hours"), "complete")
    return out.select("event_type", _seconds("start"), "n", F.bround("total", 4).alias("total"))


@query("stream_sliding", _sql("""{EV}, w AS (SELECT event_type, value, (t // 10800 - k) * 10800 AS start FROM ev, (SELECT unnest([0, 1]) AS k)) SELECT event_type, start, count(*) AS n, round_even(sum(value), 4) AS total FROM w GROUP BY ALL"""))
def stream_sliding(spark, sf_dir):
    out = feeds.table_of(feeds.tumbling(_stream(spark, sf_dir), ["event_type"], "6 hours", slide="3 hours"), "complete")
    return out.select("event_type", _seconds("start"), "n", F.bround("total", 4).alias("total"))


@query("stream_sessions", """WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 3600000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, t, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(t) // 1000000 - 1704067200 AS start, (max(t) + 3600000000) // 1000000 - 1704067200 AS stop, count(*) AS n FROM s GROUP BY user_id, session""")
def stream_sessions(spark, sf_dir):
    out = feeds.table_of(feeds.sessions(_stream(spark, sf_dir), ["user_id"], "1 hour", "40 days"), "complete")
    return out.select("user_id", _seconds("start"), _seconds("stop"), "n")


@query("stream_unique", "SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_unique(spark, sf_dir):
    return feeds.table_of(feeds.unique(_stream(spark, sf_dir), ["event_id"], "40 days").select("event_id", "user_id", "event_type"), "append")


@query("stream_latest", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_latest(spark, sf_dir):
    return feeds.table_of(feeds.latest(_stream(spark, sf_dir), ["user_id"], ["ts", "event_id"], ["event_id", "event_type"]), "complete")


@query("stream_progress", "SELECT user_id, max(event_id) AS event_id, count(*) AS n FROM events GROUP BY ALL")
def stream_progress(spark, sf_dir):
    return feeds.table_of(feeds.progress(_stream(spark, sf_dir), ["user_id"], "event_id"), "complete")


@query("stream_with_state", "SELECT event_id, user_id, c_mktsegment FROM events LEFT JOIN customer ON c_custkey = user_id")
def stream_with_state(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "user_id")
    return feeds.table_of(feeds.with_state(_stream(spark, sf_dir), customers, ["user_id"], ["c_mktsegment"]).select("event_id", "user_id", "c_mktsegment"), "append")


@query("stream_revisions", """WITH f AS (SELECT user_id, min(event_id) AS final FROM events WHERE event_type = 'error' GROUP BY ALL)
SELECT e.user_id AS id, e.event_id AS seq, e.event_type AS payload, e.event_type = 'error' AS final FROM events e LEFT JOIN f USING (user_id) WHERE e.event_id <= coalesce(f.final, e.event_id)
QUALIFY row_number() OVER (PARTITION BY e.user_id ORDER BY e.event_id DESC) = 1""")
def stream_revisions(spark, sf_dir):
    notes = _stream(spark, sf_dir).select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("payload"), (F.col("event_type") == "error").alias("final"))
    return feeds.table_of(feeds.revisions(notes), "update")


# ---- files --------------------------------------------------------------------------------------------------

def _songs(spark, sf_dir):
    """A note table: a song for each user, without overlaps on a key."""
    n = events(spark, sf_dir, "click", "view", "purchase").select(
        F.col("user_id").cast("string").alias("song_id"), F.col("t").alias("onset"), F.lit(2).alias("kind"), (F.pmod("event_id", F.lit(100)) + 15).cast("int").alias("pitch"),
        F.greatest(F.lit(1), F.rint(F.col("value") * 10)).cast("long").alias("duration"), (F.pmod("event_id", F.lit(127)) + 1).cast("int").alias("velocity"),
    )
    one = n.groupBy("song_id", "onset", "kind", "pitch").agg(F.max(F.struct("duration", "velocity")).alias("n")).select("song_id", "onset", "kind", "pitch", "n.*")
    return temporal.clip_to_next(one, ["song_id", "pitch"], "onset", "duration")


@query("midi_round_trip", _sql("""{EV}, n AS (SELECT user_id::VARCHAR AS song_id, t AS onset, (event_id % 100 + 15)::INT AS pitch, greatest(1, round_even(value * 10, 0))::BIGINT AS duration, (event_id % 127 + 1)::INT AS velocity FROM ev WHERE event_type IN ('click', 'view', 'purchase')),
o AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY song_id, onset, pitch ORDER BY duration DESC, velocity DESC) = 1),
c AS (SELECT song_id, onset, pitch, velocity, duration AS d, lead(onset) OVER (PARTITION BY song_id, pitch ORDER BY onset) AS nx FROM o)
SELECT song_id, onset, 2 AS kind, pitch, CASE WHEN onset + d > nx THEN greatest(1, nx - onset) ELSE d END AS duration, velocity FROM c WHERE pitch BETWEEN 21 AND 108"""))
def midi_round_trip(spark, sf_dir):
    """Note tables written as MIDI files and scanned again."""
    files = midi.contents(_songs(spark, sf_dir)).withColumnRenamed("song_id", "path")
    return midi.events_of(midi.scan(files), trim=False)


_STEPS = ["C", "D", "E", "F", "G", "A", "B"]


@query("musicxml_scan", """WITH n AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, o_orderkey FROM orders)
SELECT o_custkey::VARCHAR AS path, (i // 4)::INT AS measure, i::DOUBLE AS onset, 1.0::DOUBLE AS length, ([60, 62, 64, 65, 67, 69, 71][(o_orderkey % 7 + 1)::INT] + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END)::INT AS pitch FROM n""")
def musicxml_scan(spark, sf_dir):
    """A customer's orders as quarters of a score, four to a measure, written by column functions and scanned again."""
    step = F.element_at(F.array(*map(F.lit, _STEPS)), (F.pmod("o_orderkey", F.lit(7)) + 1).cast("int"))
    alter = F.when(F.pmod("o_orderkey", F.lit(3)) == 0, "<alter>1</alter>").otherwise("")
    note = F.concat(F.lit("<note><pitch><step>"), step, F.lit("</step>"), alter, F.lit("<octave>4</octave></pitch><duration>2</duration></note>"))
    notes = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", note.alias("x"))))["x"].alias("x"))
    bars = F.transform(F.sequence(F.lit(0), F.floor((F.size("x") - 1) / 4).cast("int")), lambda i: F.concat(F.lit("<measure><attributes><divisions>2</divisions></attributes>"), F.array_join(F.slice("x", i * 4 + 1, F.lit(4)), ""), F.lit("</measure>")))
    content = F.concat(F.lit("<score-partwise><part id='P1'>"), F.array_join(bars, ""), F.lit("</part></score-partwise>"))
    files = notes.select(F.col("o_custkey").cast("string").alias("path"), content.cast("binary").alias("content"))
    return musicxml.scan(files).select("path", "measure", "onset", "length", "pitch")


# ---- harmony and beats --------------------------------------------------------------------------------------

@query("mark_melody", _sql("""{EV}, n AS (SELECT event_id, user_id, t // 60 AS t, (event_id % 48 + 40)::BIGINT AS pitch FROM ev WHERE event_type IN ('click', 'view')),
m AS (SELECT DISTINCT user_id, t // 60 AS t, event_id % 12 AS c FROM ev WHERE event_type = 'purchase'),
k AS (SELECT n.event_id FROM m JOIN n ON n.user_id = m.user_id AND abs(n.t - m.t) <= 600 AND n.pitch % 12 = m.c QUALIFY row_number() OVER (PARTITION BY m.user_id, m.t, m.c ORDER BY n.pitch DESC, abs(n.t - m.t), n.event_id) = 1)
SELECT event_id, user_id, t, pitch, event_id IN (SELECT event_id FROM k) AS melody FROM n"""))
def mark_melody(spark, sf_dir):
    minute = F.floor(F.col("t") / 60).cast("long").alias("t")
    notes = events(spark, sf_dir, "click", "view").select("event_id", "user_id", minute, (F.pmod("event_id", F.lit(48)) + 40).alias("pitch"))
    melody = events(spark, sf_dir, "purchase").select("user_id", minute, F.pmod("event_id", F.lit(12)).alias("pitch"))
    return harmony.mark_melody(notes, melody, ["user_id"], "t", 600, "event_id")


@query("extend_beats", _sql("""{EV}, b AS (SELECT DISTINCT user_id, t FROM ev WHERE event_type = 'purchase'),
r AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM b),
e AS (SELECT user_id, min(t) AS a, min(t) FILTER (n = 2) AS a2, max(t) AS z, max(t) FILTER (n = c - 1) AS z2 FROM r WHERE c >= 4 GROUP BY user_id),
f AS (SELECT *, greatest(0, ceil(a / (a2 - a)::DOUBLE) + 1)::INT AS front, greatest(0, ceil((2592000 - z) / (z - z2)::DOUBLE) + 1)::INT AS back FROM e)
SELECT user_id, t, true AS given FROM r WHERE c >= 4
UNION ALL SELECT user_id, a - (a2 - a) * i, false FROM (SELECT *, unnest(generate_series(1, front)) AS i FROM f)
UNION ALL SELECT user_id, z + (z - z2) * i, false FROM (SELECT *, unnest(generate_series(1, back)) AS i FROM f)"""))
def extend_beats(spark, sf_dir):
    beats = events(spark, sf_dir, "purchase").select("user_id", "t")
    spans = beats.select("user_id").distinct().select("user_id", F.lit(0).alias("first"), F.lit(2592000).alias("last"))
    return harmony.extend_beats(beats, spans, ["user_id"], "t")


@query("chord_symbols", """WITH o AS (SELECT o_orderkey, ['C', 'C#', 'Db', 'D', 'Eb', 'E', 'F', 'F#', 'Gb', 'G', 'Ab', 'A', 'Bb', 'B', 'Cb'][(o_orderkey % 15 + 1)::INTEGER] AS root, [':maj', ':m7', ':7', ''][(o_custkey % 4 + 1)::INTEGER] AS kind, (o_custkey % 15 - 7)::INTEGER AS key FROM orders),
n AS (SELECT DISTINCT root, key, strpos('FCGDAEB', substr(root, 1, 1)) - 2 + 7 * CASE WHEN root LIKE '%#' THEN 1 WHEN root LIKE '_b' THEN -1 ELSE 0 END AS q, CASE WHEN root LIKE '%#' THEN 1 WHEN root LIKE '_b' THEN -1 ELSE 0 END AS sign FROM o),
p AS (SELECT p, floor((p + 1) / 7.0)::INTEGER AS alter_, substr('FCGDAEB', ((p + 1) % 7 + 7) % 7 + 1, 1) || CASE floor((p + 1) / 7.0)::INTEGER WHEN -1 THEN 'b' WHEN 1 THEN '#' ELSE '' END AS name FROM (SELECT unnest(range(-8, 13)) AS p)),
w AS (SELECT n.*, p.*, p BETWEEN key - 1 AND key + 5 AS own FROM n, p WHERE (p - q) % 12 = 0 AND (alter_ = 0 OR ((q * 7) % 12 + 12) % 12 NOT IN (0, 2, 4, 5, 7, 9, 11) OR p BETWEEN key - 1 AND key + 5)),
s AS (SELECT root, key, name, row_number() OVER (PARTITION BY root, key ORDER BY CASE WHEN own THEN 0 WHEN alter_ = sign THEN 1 ELSE 2 END, CASE WHEN own OR alter_ = sign THEN p ELSE 0 END, abs(p - key - 2), -alter_, p) AS nth FROM w)
SELECT o_orderkey, o.root || kind AS chord, o.key, s.name || CASE WHEN kind IN (':maj', '') THEN '' ELSE substr(kind, 2) END AS symbol FROM o LEFT JOIN s ON s.root = o.root AND s.key = o.key AND s.nth = 1""")
def chord_symbols(spark, sf_dir):
    """Chords named by orders, spelt in the key of their status and priority."""
    root = F.element_at(F.array(*[F.lit(x) for x in ("C", "C#", "Db", "D", "Eb", "E", "F", "F#", "Gb", "G", "Ab", "A", "Bb", "B", "Cb")]), (F.pmod("o_orderkey", F.lit(15)) + 1).cast("int"))
    quality = F.element_at(F.array(F.lit(":maj"), F.lit(":m7"), F.lit(":7"), F.lit("")), (F.pmod("o_custkey", F.lit(4)) + 1).cast("int"))
    key = (F.pmod("o_custkey", F.lit(15)) - 7).cast("int")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(root, quality).alias("chord"), key.alias("key")).withColumn("symbol", harmony.chord_symbol(F.col("chord"), F.col("key")))


# ---- note tables --------------------------------------------------------------------------------------------

@query("augment_notes", _sql("""{EV}, n AS (SELECT user_id::VARCHAR AS song_id, t AS onset, (event_id % 100 + 15) AS pitch, (event_id % 127 + 1)::INT AS velocity, greatest(1, round_even(value * 10, 0))::BIGINT AS d FROM ev WHERE event_type IN ('click', 'view', 'purchase')),
o AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY song_id, onset, pitch ORDER BY d DESC, velocity DESC) = 1),
c AS (SELECT *, lead(onset) OVER (PARTITION BY song_id, pitch ORDER BY onset) AS nx FROM o),
s AS (SELECT song_id, round_even(onset * 1.1::DOUBLE, 0)::BIGINT AS onset, (pitch + 5)::INT AS pitch, greatest(1, round_even(CASE WHEN onset + d > nx THEN greatest(1, nx - onset) ELSE d END * 1.1::DOUBLE, 0))::BIGINT AS duration, greatest(1, least(127, velocity - 20))::INT AS velocity FROM c)
SELECT song_id, 2 AS kind, pitch, duration, velocity,
  CASE WHEN onset < 100000 THEN greatest(0, round_even(onset + greatest(0.0::DOUBLE, least(1.0::DOUBLE, (100000 - onset) / 5000.0::DOUBLE)) * 30, 0))::BIGINT ELSE onset END AS onset
FROM s WHERE pitch BETWEEN 21 AND 108"""))
def augment_notes(spark, sf_dir):
    """Stretched, transposed, quieter, and drifting before a split."""
    n = notes.louder(notes.transposed(notes.stretch(_songs(spark, sf_dir), 1.1), 5), -20)
    return notes.drift(n, 100_000, 30, 5000)


@query("change_stats", """WITH c AS (SELECT *, lag(l_returnflag) OVER w AS rf, lag(l_linestatus) OVER w AS ls, row_number() OVER w AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
u AS (SELECT 'l_returnflag' AS "column", l_returnflag <> rf AS ch, l_quantity AS q FROM c WHERE n > 1 UNION ALL SELECT 'l_linestatus', l_linestatus <> ls, l_quantity FROM c WHERE n > 1)
SELECT "column", count(*) FILTER (ch) AS n_changed, round_even(avg(q) FILTER (ch), 6) AS changed, count(*) FILTER (NOT ch) AS n_same, round_even(avg(q) FILTER (NOT ch), 6) AS same FROM u GROUP BY ALL""")
def change_stats(spark, sf_dir):
    s = notes.change_stats(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], ["l_returnflag", "l_linestatus"], "l_quantity")
    return s.select("column", "n_changed", F.bround("changed", 6).alias("changed"), "n_same", F.bround("same", 6).alias("same"))


# ---- bars, beats and windows --------------------------------------------------------------------------------

def _kind(spark, sf_dir, *kinds: str):
    return events(spark, sf_dir, *kinds).select("user_id", "t").distinct()


@query("running_max", _sql("""{EV} SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS top FROM ev"""))
def running_max(spark, sf_dir):
    return series.running_max(events(spark, sf_dir), ["user_id"], ["t", "event_id"], "value", "top").select("event_id", "top")


@query("sliding_count", _sql("""{EV} SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 7200 PRECEDING AND 7200 FOLLOWING) AS near FROM ev"""))
def sliding_count(spark, sf_dir):
    return series.sliding_count(events(spark, sf_dir), ["user_id"], "t", 7200, "near").select("event_id", "near")


@query("local_slope", DAILY + """, s AS (SELECT event_type, day, (last(m) OVER w - first(m) OVER w) / (last(day) OVER w - first(day) OVER w) AS slope FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
q AS (SELECT event_type, quantile_cont(slope, 0.5) AS median FROM s GROUP BY ALL)
SELECT event_type, day, round_even(slope, 6) AS slope, round_even(slope / nullif(median, 0), 6) AS slope_ratio FROM s JOIN q USING (event_type)""")
def local_slope(spark, sf_dir):
    r = series.local_slope(_daily(spark, sf_dir).select("event_type", "day", "m"), ["event_type"], "day", "m", 2, "slope")
    return r.select("event_type", "day", F.bround("slope", 6).alias("slope"), F.bround("slope_ratio", 6).alias("slope_ratio"))


@query("ragged_offsets", """SELECT doc_id, source, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM documents""")
def ragged_offsets(spark, sf_dir):
    return series.offsets(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), ["source"], ["doc_id"], "n_chars", "offset")


@query("last_rows", _sql("""{EV} SELECT event_id, user_id FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) <= 30"""))
def last_rows(spark, sf_dir):
    return series.last_rows(events(spark, sf_dir), ["user_id"], ["t", "event_id"], 30).select("event_id", "user_id")


@query("length_ratio", _sql("""{EV}, c AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'view') AS b FROM ev GROUP BY ALL)
SELECT user_id, a, b FROM c WHERE b > 0 AND a / b BETWEEN 0.75::DOUBLE AND 1.33::DOUBLE"""))
def length_ratio(spark, sf_dir):
    """Pairs whose lengths are alike."""
    one = lambda k: F.count(F.when(F.col("event_type") == k, 1))
    return events(spark, sf_dir).groupBy("user_id").agg(one("click").alias("a"), one("view").alias("b")).where("b > 0 and a / b between 0.75 and 1.33")


def _segments(spark, sf_dir):
    """A segment from each error of a user to the next, an hour to the beat, three or four to the bar."""
    stop = F.lead("t").over(Window.partitionBy("user_id").orderBy("t"))
    e = _kind(spark, sf_dir, "error").select("user_id", F.col("t").alias("start"), stop.alias("stop"), F.lit(3600).alias("period"), (F.pmod("t", F.lit(2)) + 3).cast("int").alias("meter"))
    return e.where("stop is not null")


_SEGMENTS = """{EV}, x AS (SELECT DISTINCT user_id, t FROM ev WHERE event_type = 'error'),
seg AS (SELECT * FROM (SELECT user_id, t AS start, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS stop, (t % 2 + 3)::INT AS meter FROM x) WHERE stop IS NOT NULL)"""


@query("bar_beats", _sql(_SEGMENTS + """, b AS (SELECT *, unnest(generate_series(0, ceil((stop - start) / 3600.0::DOUBLE)::INT - 1))::INT AS beat FROM seg)
SELECT user_id, start, beat, start + beat * 3600 AS t, (beat % meter)::INT AS position, (beat // meter)::INT AS bar FROM b"""))
def bar_beats(spark, sf_dir):
    return axis.beats_of_segments(_segments(spark, sf_dir), ["user_id"], "start", "stop", "period", "meter")


@query("span_features", _sql(_SEGMENTS + """ SELECT seg.user_id, seg.start, seg.stop, count(e.event_id) AS n, round_even(avg(e.value), 6) AS mean, round_even(max(e.value) - min(e.value), 6) AS span
FROM seg LEFT JOIN ev e ON e.user_id = seg.user_id AND e.event_type = 'click' AND e.t >= seg.start AND e.t < seg.stop GROUP BY ALL"""))
def span_features(spark, sf_dir):
    r = axis.span_features(events(spark, sf_dir, "click").select("user_id", "t", "value"), _segments(spark, sf_dir), ["user_id"], "t", "value", "start", "stop")
    return r.select("user_id", "start", "stop", "n", F.bround("mean", 6).alias("mean"), F.bround("span", 6).alias("span"))


@query("flag_downbeats", _sql("""{EV}, b AS (SELECT DISTINCT user_id, t FROM ev WHERE event_type = 'click'), d AS (SELECT DISTINCT user_id, t FROM ev WHERE event_type = 'purchase'),
n AS (SELECT d.user_id, p.t AS pt, q.t AS qt, d.t FROM d ASOF LEFT JOIN b p ON d.user_id = p.user_id AND d.t >= p.t ASOF LEFT JOIN b q ON d.user_id = q.user_id AND d.t < q.t),
h AS (SELECT DISTINCT user_id, CASE WHEN qt IS NOT NULL AND (pt IS NULL OR qt - t < t - pt) THEN qt ELSE pt END AS t FROM n)
SELECT b.user_id, b.t, h.t IS NOT NULL AS downbeat FROM b LEFT JOIN h ON h.user_id = b.user_id AND h.t = b.t"""))
def flag_downbeats(spark, sf_dir):
    return axis.flag_downbeats(_kind(spark, sf_dir, "click"), _kind(spark, sf_dir, "purchase"), ["user_id"], "t")


@query("tempo_timeline", _sql("""{EV}, p AS (SELECT user_id, t, max(event_id % 7 + 1) AS k FROM ev WHERE event_type = 'purchase' GROUP BY ALL),
l AS (SELECT *, lag(t) OVER w AS lt, lag(k) OVER w AS lk FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t)),
a AS (SELECT *, sum(CASE WHEN lt IS NULL THEN t * 5 ELSE (t - lt) * lk END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING)::BIGINT AS at FROM l)
SELECT c.event_id, CASE WHEN a.at IS NULL THEN c.t * 5 ELSE a.at + (c.t - a.t) * a.k END AS at FROM (SELECT * FROM ev WHERE event_type = 'click') c ASOF LEFT JOIN a ON c.user_id = a.user_id AND c.t >= a.t"""))
def tempo_timeline(spark, sf_dir):
    tempos = events(spark, sf_dir, "purchase").groupBy("user_id", "t").agg(F.max(F.pmod("event_id", F.lit(7)) + 1).alias("k"))
    return axis.time_of(events(spark, sf_dir, "click").select("event_id", "user_id", "t"), tempos, ["user_id"], "t", "k", "at", default=5).select("event_id", "at")


@query("beat_levels", _sql("""{EV}, b AS (SELECT DISTINCT user_id, t FROM ev WHERE event_type = 'click'), s AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t) - t AS step FROM b),
m AS (SELECT *, list_sort([coalesce(lag(step) OVER w, step), step, coalesce(lead(step) OVER w, step)])[2] AS mid FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t)),
q AS (SELECT user_id, quantile_cont(step, 0.5) AS median FROM s GROUP BY ALL)
SELECT user_id, t, step, CASE WHEN step IS NULL THEN NULL WHEN mid / median < 0.7::DOUBLE THEN 0.5::DOUBLE WHEN mid / median > 1.4::DOUBLE THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS level FROM m JOIN q USING (user_id)"""))
def beat_levels(spark, sf_dir):
    return axis.beat_levels(_kind(spark, sf_dir, "click"), ["user_id"], "t")


@query("steady_share", _sql("""{EV}, b AS (SELECT DISTINCT user_id, t FROM ev), s AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t) - t AS step FROM b),
o AS (SELECT *, abs(lead(step) OVER (PARTITION BY user_id ORDER BY t) / nullif(step, 0)::DOUBLE - 1) <= 0.5::DOUBLE AS ok FROM s)
SELECT user_id, count(step) AS n, round_even(avg(ok::INT), 9) AS steady FROM o GROUP BY ALL"""))
def steady_share(spark, sf_dir):
    r = axis.steady_share(_kind(spark, sf_dir), ["user_id"], "t", 0.5)
    return r.select("user_id", "n", F.bround("steady", 9).alias("steady"))


@query("memory_windows", _sql("""{EV}, n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS n, count(*) OVER (PARTITION BY user_id) AS c FROM ev),
w AS (SELECT *, unnest(generate_series(n // 16, least((c - 1) // 16, (n + 4) // 16))) AS win FROM n)
SELECT event_id, win::INT AS "window", (n - greatest(win * 16 - 4, 0))::INT AS place, n >= win * 16 AS loss FROM w"""))
def memory_windows(spark, sf_dir):
    return axis.windows_with_memory(events(spark, sf_dir), ["user_id"], ["t", "event_id"], 16, 4).select("event_id", "window", "place", "loss")


@query("padded_collate", """WITH c AS (SELECT conv_id, list(length(text) ORDER BY turn, role, text) AS xs FROM conversations GROUP BY ALL), b AS (SELECT conv_id // 8 AS batch, max(len(xs)) AS longest FROM c GROUP BY ALL)
SELECT conv_id, conv_id // 8 AS batch, len(xs)::INT AS length, array_to_string(list_concat(xs, list_transform(range(longest - len(xs)), lambda i: 0)), ',') AS xs FROM c JOIN b ON b.batch = conv_id // 8""")
def padded_collate(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text")))["text"].alias("xs"))
    c = c.select("conv_id", F.floor(F.col("conv_id") / 8).cast("long").alias("batch"), F.transform("xs", F.length).alias("xs"))
    return axis.padded(c, ["batch"], "xs").select("conv_id", "batch", "length", F.array_join(F.col("xs").cast("array<string>"), ",").alias("xs"))


@query("note_match", _sql("""{EV}, a AS (SELECT user_id, t, min(event_id) AS id_a FROM ev WHERE event_type = 'click' GROUP BY ALL), b AS (SELECT user_id, t, min(event_id) AS id_b FROM ev WHERE event_type = 'view' GROUP BY ALL),
x AS (SELECT a.*, p.t AS pt, p.id_b AS pb, q.t AS qt, q.id_b AS qb FROM a ASOF LEFT JOIN b p ON a.user_id = p.user_id AND a.t >= p.t ASOF LEFT JOIN b q ON a.user_id = q.user_id AND a.t < q.t),
m AS (SELECT id_a, t, CASE WHEN qt IS NOT NULL AND (pt IS NULL OR qt - t < t - pt) THEN qb ELSE pb END AS id_b, CASE WHEN qt IS NOT NULL AND (pt IS NULL OR qt - t < t - pt) THEN qt ELSE pt END AS nt FROM x),
y AS (SELECT b.*, p.t AS pt, p.id_a AS pa, q.t AS qt, q.id_a AS qa FROM b ASOF LEFT JOIN a p ON b.user_id = p.user_id AND b.t >= p.t ASOF LEFT JOIN a q ON b.user_id = q.user_id AND b.t < q.t),
r AS (SELECT id_b, CASE WHEN qt IS NOT NULL AND (pt IS NULL OR qt - t < t - pt) THEN qa ELSE pa END AS id_a FROM y)
SELECT m.id_a, m.id_b, m.nt - m.t AS off FROM m JOIN r ON r.id_b = m.id_b AND r.id_a = m.id_a WHERE abs(m.nt - m.t) <= 36000"""))
def note_match(spark, sf_dir):
    one = lambda k, name: events(spark, sf_dir, k).groupBy("user_id", "t").agg(F.min("event_id").alias(name))
    return axis.mutual_nearest(one("click", "id_a"), one("view", "id_b"), ["user_id"], "t", "id_a", "id_b", 36_000)


@query("best_scale", _sql("""{EV}, a AS (SELECT DISTINCT user_id, t // 3600 AS h FROM ev WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id, t // 3600 AS h FROM ev WHERE event_type = 'view'),
s AS (SELECT unnest(['half', 'same', 'twice']) AS scale, unnest([1, 1, 2]) AS num, unnest([2, 1, 1]) AS den),
h AS (SELECT b.user_id, s.scale, count(*) AS hit FROM b, s, a WHERE b.h * s.num % s.den = 0 AND a.user_id = b.user_id AND a.h = b.h * s.num // s.den GROUP BY ALL),
na AS (SELECT user_id, count(*) AS n FROM a GROUP BY ALL), nb AS (SELECT user_id, count(*) AS n FROM b GROUP BY ALL),
f AS (SELECT h.user_id, scale, 2.0::DOUBLE * hit / (na.n + nb.n) AS f1 FROM h JOIN na USING (user_id) JOIN nb USING (user_id))
SELECT user_id, scale, round_even(f1, 9) AS f1 FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY f1 DESC, scale) = 1"""))
def best_scale(spark, sf_dir):
    hours = lambda kind: events(spark, sf_dir, kind).select("user_id", F.floor(F.col("t") / HOUR).cast("long").alias("h"))
    r = axis.best_scale(hours("click"), hours("view"), ["user_id"], "h", {"half": (1, 2), "same": (1, 1), "twice": (2, 1)})
    return r.select("user_id", "scale", F.bround("f1", 9).alias("f1"))


# ---- scalars and predicates ---------------------------------------------------------------------------------

@query("snapped_fractions", """WITH x AS (SELECT event_id, value / 10 AS x FROM events), d AS (SELECT unnest([1, 2, 3, 4, 6, 8, 12, 16]) AS den)
SELECT event_id, round_even(x * den, 0)::BIGINT AS num, den::INT AS den FROM x, d WHERE abs(x - round_even(x * den, 0) / den) <= 0.02::DOUBLE QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY den) = 1""")
def snapped_fractions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", scalar.snap_to_fraction(F.col("value") / 10).alias("f"))
    return e.where("f is not null").select("event_id", "f.num", "f.den")


@query("error_reasons", r"""SELECT trim(regexp_replace(regexp_replace(regexp_replace(url, '''[^'']*''|"[^"]*"', '''''', 'g'), '(/[A-Za-z0-9_.-]+)+', '/', 'g'), '[0-9]+', '#', 'g')) AS reason, count(*) AS n FROM pages GROUP BY ALL""")
def error_reasons(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(scalar.error_reason(F.col("url")).alias("reason")).agg(F.count("*").alias("n"))


@query("floor_div", """SELECT o_orderkey, CASE WHEN x % 7 < 0 THEN x // 7 - 1 ELSE x // 7 END AS q FROM (SELECT o_orderkey, (9007199254740993 + o_orderkey) * CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS x FROM orders)""")
def floor_div(spark, sf_dir):
    x = (F.lit(9007199254740993) + F.col("o_orderkey")) * F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1)
    return table(spark, sf_dir, "orders").select("o_orderkey", scalar.floor_div(x, 7).alias("q"))


@query("private_order", """SELECT l_returnflag, row_number() OVER (ORDER BY md5('5:' || l_returnflag), l_returnflag) - 1 AS label FROM (SELECT DISTINCT l_returnflag FROM lineitem)""")
def private_order(spark, sf_dir):
    """Categories numbered in an order of their own, drawn from a seed."""
    order = Window.orderBy(F.md5(F.concat(F.lit("5:"), "l_returnflag").cast("binary")), "l_returnflag")  # a row for each category
    return table(spark, sf_dir, "lineitem").select("l_returnflag").distinct().select("l_returnflag", (F.row_number().over(order) - 1).cast("long").alias("label"))


@query("length_buckets", """SELECT CASE WHEN n_chars < 200 THEN 0 WHEN n_chars < 1000 THEN 1 WHEN n_chars < 5000 THEN 2 ELSE 3 END AS bucket, count(*) AS n, sum(n_chars)::BIGINT AS chars, max(n_chars) AS longest FROM documents GROUP BY ALL""")
def length_buckets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("n_chars", scalar.bin_of(F.col("n_chars") + 0.5, [200.0, 1000.0, 5000.0]).alias("bucket"))
    return d.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


@query("unseen_tokens", """SELECT v.q::INT AS quantity FROM (SELECT unnest(generate_series(0, 60)) AS q) v WHERE v.q NOT IN (SELECT l_quantity::INT FROM lineitem WHERE l_returnflag = 'R')""")
def unseen_tokens(spark, sf_dir):
    """Tokens of the vocabulary that training never has."""
    seen = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_quantity").cast("int").alias("quantity"))
    return corpus.exclude(spark.range(61).select(F.col("id").cast("int").alias("quantity")), seen, ["quantity"])


@query("all_sides", """SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def all_sides(spark, sf_dir):
    """Customers that all three relations know."""
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders")
    for side in ("o_orderstatus = 'F'", "o_orderstatus = 'O'", "o_orderpriority = '1-URGENT'"):
        c = c.join(o.where(side).select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    return c


@query("increasing_groups", _sql("""{EV}, s AS (SELECT user_id, t // 86400 AS day, value, lag(value) OVER (PARTITION BY user_id, t // 86400 ORDER BY event_id) AS before, row_number() OVER (PARTITION BY user_id, t // 86400 ORDER BY event_id) AS n FROM ev)
SELECT user_id, day FROM s GROUP BY ALL HAVING count(*) >= 2 AND bool_and(value IS NOT NULL AND (n = 1 OR coalesce(value > before, false)))"""))
def increasing_groups(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("day", F.floor(F.col("t") / 86400).cast("long"))
    return groups.increasing(e, ["user_id", "day"], ["event_id"], "value", 2)


@query("swing_share", _sql("""{EV}, s AS (SELECT user_id, avg((t % 2 = 1)::INT) AS share FROM ev WHERE event_type IN ('click', 'view') GROUP BY ALL)
SELECT user_id, round_even(share, 9) AS share FROM s WHERE share BETWEEN 0.4::DOUBLE AND 0.6::DOUBLE"""))
def swing_share(spark, sf_dir):
    r = groups.share_between(events(spark, sf_dir), ["user_id"], F.col("t") % 2 == 1, F.col("event_type").isin("click", "view"), 0.4, 0.6)
    return r.select("user_id", F.bround("share", 9).alias("share"))


@query("notation_rich", _sql("""{EV} SELECT user_id, count(*) FILTER (event_type = 'error') / greatest(1, count(*) FILTER (event_type = 'click')) >= 0.1::DOUBLE AND bool_or(value > 200) AS rich FROM ev GROUP BY ALL"""))
def notation_rich(spark, sf_dir):
    kind = F.col("event_type")
    return groups.richness(events(spark, sf_dir), ["user_id"], kind == "error", kind == "click", F.col("value") > 200, 0.1)


@query("group_lookup", """SELECT event_id, CASE event_type WHEN 'click' THEN 'look' WHEN 'view' THEN 'look' WHEN 'purchase' THEN 'buy' ELSE 'other' END AS kind FROM events""")
def group_lookup(spark, sf_dir):
    small = spark.createDataFrame([("click", "look"), ("view", "look"), ("purchase", "buy")], "event_type string, kind string")
    return groups.lookup(events(spark, sf_dir), small, "event_type", "kind", "other").select("event_id", "kind")


@query("end_slopes", _sql("""{EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS up, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS down FROM ev)
SELECT user_id, round_even(regr_slope(t, up) FILTER (up <= 8), 3) AS head, round_even(regr_slope(t, up) FILTER (down <= 8), 3) AS tail FROM r GROUP BY ALL"""))
def end_slopes(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")))
    r = groups.end_slopes(e, ["user_id"], ["t", "event_id"], "n", "t")
    return r.select("user_id", F.bround("head", 3).alias("head"), F.bround("tail", 3).alias("tail"))


@query("evaluation_windows", """WITH d AS (SELECT doc_id, n_chars FROM documents WHERE n_chars >= 512) SELECT doc_id, s AS start, s + 512 AS stop FROM (SELECT doc_id, unnest(generate_series(0, n_chars - 512, 512)) AS s FROM d)""")
def evaluation_windows(spark, sf_dir):
    return groups.evaluation_windows(table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("long").alias("n")), "n", 512).select("doc_id", "start", "stop")


@query("lcm_denominators", """SELECT l_orderkey, list_reduce(list_prepend(1::BIGINT, list(DISTINCT l_quantity::BIGINT % 12 + 1)), lambda a, b: lcm(a, b)) AS divisions FROM lineitem GROUP BY ALL""")
def lcm_denominators(spark, sf_dir):
    q = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_quantity").cast("long") % 12 + 1).alias("q"))
    return q.select("l_orderkey", scalar.lcm_of(F.col("q")).alias("divisions"))


@query("overlaid_props", """SELECT event_id, coalesce(json_extract_string(props, '$.k'), '0') AS k, 'none' AS z FROM events""")
def overlaid_props(spark, sf_dir):
    m = scalar.overlay_json(F.lit('{"k": "0", "z": "none"}'), F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", m.alias("m")).select("event_id", F.col("m")["k"].alias("k"), F.col("m")["z"].alias("z"))


@query("first_matches", """SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'the|and') THEN 'a' WHEN regexp_matches(lower(text), '[0-9]') THEN 'b' WHEN regexp_matches(lower(text), 'e') THEN 'c' END AS kind,
  regexp_matches(lower(text), 'the|and')::INT + regexp_matches(lower(text), '[0-9]')::INT + regexp_matches(lower(text), 'e')::INT AS n FROM documents WHERE text IS NOT NULL""")
def first_matches(spark, sf_dir):
    kinds = {"a": "the|and", "b": "[0-9]", "c": "e"}
    text = F.col("text")
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", scalar.first_match(text, kinds).alias("kind"), F.size(scalar.all_matches(text, kinds)).alias("n"))


@query("remapped_tokens", """WITH o AS (SELECT l_orderkey, list(l_quantity::INT % 11 ORDER BY l_linenumber, l_quantity) AS x FROM lineitem GROUP BY ALL)
SELECT l_orderkey, array_to_string(CASE WHEN list_contains(x, 9) OR list_contains(x, 10) THEN x ELSE list_transform(x, lambda t: (t * 2 + 1) % 9) END, ',') AS x FROM o""")
def remapped_tokens(spark, sf_dir):
    """9 is -1 in the table, and 10 is beyond it."""
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity")))["l_quantity"].alias("q"))
    moved = F.array(*[F.lit((t * 2 + 1) % 9) for t in range(9)], F.lit(-1))
    x = scalar.remap(F.transform("q", lambda v: v.cast("int") % 11), moved)
    return o.select("l_orderkey", F.array_join(x.cast("array<string>"), ",").alias("x"))


@query("score_scalars", """SELECT l_orderkey, l_linenumber, least(greatest(floor(l_quantity * 3 * 32 / 128), 0), 31)::INT AS velocity, (l_quantity::BIGINT // 60)::VARCHAR || ':' || lpad((l_quantity::BIGINT % 60)::VARCHAR, 2, '0') AS clock,
  round_even(exp(-(l_discount * l_discount) / 0.02::DOUBLE), 9) AS bias, round_even(l_linenumber * 4.0::DOUBLE / 8, 9) AS measure,
  CASE WHEN l_quantity < 10 THEN floor((10 - l_quantity) / 2) WHEN l_quantity > 40 THEN floor((l_quantity - 40) / 2) ELSE 0 END::INT AS ledger FROM lineitem""")
def score_scalars(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", scalar.velocity_bin(q * 3).alias("velocity"), scalar.clock(q).alias("clock"), F.bround(scalar.time_bias(F.col("l_discount"), 0.1), 9).alias("bias"),
        F.bround(scalar.meter_length(F.col("l_linenumber"), F.lit(8)), 9).alias("measure"), scalar.ledger_lines(q, 10, 40).alias("ledger"))


from . import choices, origins, rules  # noqa: E402, F401  register their queries
