"""Queries of the operators whose answers depend on answers before them, and of alignment and comparison, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names, scalar
from ..operators import align, arrangement, bars, grids, notes, scans, sequences
from ..streaming import feeds, timers
from .catalogue import SQL, _kind, _notes, _sql, events, query, table


# ---- anchors, ramps, feedback --------------------------------------------------------------------------------

@query("merge_close", _sql("""WITH RECURSIVE """ + """{EV}""".replace("WITH ", "") + """,
p AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t) AS n FROM (SELECT DISTINCT user_id, event_type, t FROM ev)),
a AS (SELECT user_id, event_type, n, t, t AS anchor FROM p WHERE n = 1
  UNION ALL SELECT p.user_id, p.event_type, p.n, p.t, CASE WHEN p.t - a.anchor >= 400000 THEN p.t ELSE a.anchor END FROM a JOIN p ON p.user_id = a.user_id AND p.event_type = a.event_type AND p.n = a.n + 1),
g AS (SELECT a.user_id, a.event_type, a.anchor AS onset, max(e.t + floor(e.value * 2000)::BIGINT) AS stop, max(floor(e.value)::BIGINT) AS level FROM ev e JOIN a ON a.user_id = e.user_id AND a.event_type = e.event_type AND a.t = e.t GROUP BY ALL),
w AS (SELECT *, lead(onset) OVER (PARTITION BY user_id, event_type ORDER BY onset) AS nxt FROM g)
SELECT user_id, event_type, onset, greatest(CASE WHEN nxt IS NULL THEN stop ELSE least(stop, nxt - 600) END, onset + 1000) AS stop, level FROM w""").replace("WITH RECURSIVE WITH ", "WITH RECURSIVE "))
def merge_close(spark, sf_dir):
    e = events(spark, sf_dir).withColumns({"stop": F.col("t") + F.floor(F.col("value") * 2000), "level": F.floor("value"), "onset": F.col("t")})
    return scans.merge_close(e, ["user_id", "event_type"], "onset", "stop", ["level"], 400_000, 600, 1000)


@query("prune_ramps", _sql("""WITH RECURSIVE """ + """{EV}""" + """,
r AS (SELECT 0 AS step, user_id, event_id, t, (80 + event_id % 11)::DOUBLE AS bpm FROM ev
  UNION ALL SELECT step + 1, user_id, event_id, t, bpm FROM (
    SELECT *, max(CASE WHEN dt < 86400 AND abs(ln(bpm / was)) < 0.06::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, t, bpm) AS gone FROM (
      SELECT *, t - lag(t) OVER w AS dt, lag(bpm) OVER w AS was FROM r WHERE step < 40 WINDOW w AS (PARTITION BY user_id ORDER BY t, bpm, event_id)))
  WHERE gone = 0)
SELECT user_id, event_id, t, bpm FROM r WHERE step = 40""").replace("RECURSIVE WITH ", "RECURSIVE "))
def prune_ramps(spark, sf_dir):
    marks = events(spark, sf_dir).select("user_id", "event_id", "t", (80 + F.col("event_id") % 11).cast("double").alias("bpm"))
    return scans.prune_ramps(marks, ["user_id"], "t", "bpm", 86_400, 0.06)


STEPS = scans.log_values(0.02, 30.0, 128)


def _starts(spark, sf_dir):
    """A user's events as measures: hundredths of a quarter of an hour since the first, which begins a little before 0."""
    e = events(spark, sf_dir)
    first = e.groupBy("user_id").agg(F.min("t").alias("first"))
    return e.join(first, "user_id").select("user_id", "event_id", "t", ((F.col("t") - F.col("first")) / 90_000.0 - (F.col("user_id") % 5) / 10.0).alias("start"))


@query("quantise_feedback", _sql("""WITH RECURSIVE """ + """{EV}""" + f""",
v AS (SELECT {STEPS!r}::DOUBLE[] AS v, {[math.log(x) for x in STEPS[1:]]!r}::DOUBLE[] AS logs),
s AS (SELECT user_id, event_id, (t - min(t) OVER (PARTITION BY user_id)) / 90000.0::DOUBLE - (user_id % 5) / 10.0::DOUBLE AS start, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM ev),
q AS (SELECT user_id, event_id, n, start, CASE WHEN -start < 0.01::DOUBLE THEN 0 ELSE list_position(list_transform(v.logs, lambda y: abs(y - ln(-start))), list_min(list_transform(v.logs, lambda y: abs(y - ln(-start))))) END AS bin,
    -v.v[CASE WHEN -start < 0.01::DOUBLE THEN 0 ELSE list_position(list_transform(v.logs, lambda y: abs(y - ln(-start))), list_min(list_transform(v.logs, lambda y: abs(y - ln(-start))))) END + 1] AS decoded FROM s, v WHERE n = 1
  UNION ALL SELECT user_id, event_id, n, start, bin, was + v.v[bin + 1] FROM (
    SELECT s.user_id, s.event_id, s.n, s.start, q.decoded AS was, v.v AS v,
      CASE WHEN s.start - q.decoded < 0.01::DOUBLE THEN 0 ELSE list_position(list_transform(v.logs, lambda y: abs(y - ln(s.start - q.decoded))), list_min(list_transform(v.logs, lambda y: abs(y - ln(s.start - q.decoded))))) END AS bin
    FROM q JOIN s ON s.user_id = q.user_id AND s.n = q.n + 1, v) v)
SELECT event_id, bin::INTEGER AS bin, round_even(decoded, 6) AS decoded FROM q""").replace("RECURSIVE WITH ", "RECURSIVE "))
def quantise_feedback(spark, sf_dir):
    q = scans.quantise_feedback(_starts(spark, sf_dir), ["user_id"], ["t", "event_id"], "start", STEPS)
    return q.select("event_id", "bin", F.bround("decoded", 6).alias("decoded"))


@query("decoded_starts", _sql("""{EV}, b AS (SELECT user_id, event_id, t, event_id % 128 AS bin, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM ev)
SELECT event_id, round_even(sum(CASE WHEN n = 1 THEN -1 ELSE 1 END * ({STEPS}::DOUBLE[])[bin + 1]) OVER (PARTITION BY user_id ORDER BY n), 6) AS start FROM b""").replace("{STEPS}", repr(STEPS)))
def decoded_starts(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("bin", (F.col("event_id") % 128).cast("int"))
    return scans.decode_steps(e, ["user_id"], ["t", "event_id"], F.col("bin"), STEPS, "start").select("event_id", F.bround("start", 6).alias("start"))


@query("raw_times", _sql("""WITH RECURSIVE """ + """{EV}""" + """,
n AS (SELECT user_id, event_id, t / 3600.0::DOUBLE AS t, event_id % 5 AS p, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS n FROM ev),
raw AS (SELECT user_id, p, t + (user_id % 9 - 4) + 0.5::DOUBLE * (n // 40) + (event_id % 5 - 2) / 1000.0::DOUBLE AS x FROM n WHERE event_id % 11 <> 0),
r AS (SELECT user_id, -1::BIGINT AS w, NULL::DOUBLE AS held, false AS voted FROM n GROUP BY user_id
  UNION ALL SELECT user_id, w, CASE WHEN n_close >= greatest(3, 0.3::DOUBLE * size) THEN mid ELSE held END, n_close >= greatest(3, 0.3::DOUBLE * size) FROM (
    SELECT user_id, w, held, size, count(*) FILTER (abs(d - mode * 0.01::DOUBLE) < 0.03::DOUBLE) AS n_close, median(d) FILTER (abs(d - mode * 0.01::DOUBLE) < 0.03::DOUBLE) AS mid FROM (
      SELECT *, first_value(cell) OVER (PARTITION BY user_id ORDER BY votes DESC, cell) AS mode FROM (
        SELECT *, count(d) OVER (PARTITION BY user_id ORDER BY cell RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS votes FROM (
          SELECT r.user_id, r.w + 1 AS w, r.held, z.size, raw.x - n.t AS d, round_even((raw.x - n.t) / 0.01::DOUBLE, 0) AS cell
          FROM r JOIN n ON n.user_id = r.user_id AND n.n // 48 = r.w + 1 JOIN (SELECT user_id, n // 48 AS w, count(*) AS size FROM n GROUP BY ALL) z ON z.user_id = r.user_id AND z.w = r.w + 1
          LEFT JOIN raw ON raw.user_id = n.user_id AND raw.p = n.p AND raw.x > n.t + coalesce(r.held, 0) - CASE WHEN r.held IS NULL THEN 30 ELSE 4 END AND raw.x < n.t + coalesce(r.held, 0) + CASE WHEN r.held IS NULL THEN 30 ELSE 4 END)))
    GROUP BY user_id, w, held, size)),
f AS (SELECT n.event_id, arg_min(raw.x, abs(raw.x - n.t - r.held)) AS x, min(abs(raw.x - n.t - r.held)) AS off FROM n JOIN r ON r.user_id = n.user_id AND r.w = n.n // 48 AND r.voted JOIN raw ON raw.user_id = n.user_id AND raw.p = n.p GROUP BY n.event_id)
SELECT n.event_id, round_even(CASE WHEN f.off < 0.03::DOUBLE THEN f.x END, 6) AS raw_t, round_even(CASE WHEN r.voted THEN r.held END, 6) AS shift
FROM n JOIN r ON r.user_id = n.user_id AND r.w = n.n // 48 LEFT JOIN f ON f.event_id = n.event_id""").replace("RECURSIVE WITH ", "RECURSIVE "))
def raw_times(spark, sf_dir):
    """A user's events, an hour as a second, found again among themselves: most of them, moved by a shift that grows, and a little off."""
    e = events(spark, sf_dir).select("user_id", "event_id", (F.col("t") / 3600.0).alias("t"), (F.col("event_id") % 5).alias("p"))
    e = e.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")) - 1)
    moved = F.col("t") + (F.col("user_id") % 9 - 4) + 0.5 * F.floor(F.col("n") / 40) + (F.col("event_id") % 5 - 2) / 1000.0
    found = align.raw_times(e, e.where("event_id % 11 <> 0").select("user_id", moved.alias("t"), "p"), ["user_id"], ["t", "event_id"], "t", "p")
    return found.select("event_id", F.bround("raw_t", 6).alias("raw_t"), F.bround("shift", 6).alias("shift"))


# ---- levels of beats, pedal-safe lengths ---------------------------------------------------------------------

#: A user's events as beats; seven at a time they are 1/2, 1, 2 or 1.5 source beats, each a few 64ths off, and views of a high value are unusable.
_BEATS = """, b0 AS (SELECT user_id, t, min(event_id) AS event_id, bool_or(event_type = 'view' AND value > 50) AS bad FROM ev GROUP BY user_id, t),
b1 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS n FROM b0),
b AS (SELECT user_id, t, n, NOT bad AS usable, sum(([0.5::DOUBLE, 1, 2, 1.5])[((user_id + n // 7) % 4 + 1)::INTEGER]) OVER (PARTITION BY user_id ORDER BY n) + (event_id % 7 - 3) / 64.0::DOUBLE AS mapped FROM b1)"""
_LEVELS = """, s AS (SELECT *, lead(mapped) OVER w - mapped AS step, usable AND lead(usable) OVER w AS ok, count(*) OVER (PARTITION BY user_id) AS c FROM b WINDOW w AS (PARTITION BY user_id ORDER BY t)),
m AS (SELECT *, median(step) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS mid FROM s),
d AS (SELECT *, abs(ln(greatest(mid, 1e-6::DOUBLE)) - ln(0.5::DOUBLE)) AS d0, abs(ln(greatest(mid, 1e-6::DOUBLE))) AS d1, abs(ln(greatest(mid, 1e-6::DOUBLE)) - ln(2.0::DOUBLE)) AS d2 FROM m),
l AS (SELECT *, CASE WHEN step IS NULL THEN NULL WHEN NOT ok OR least(d0, d1, d2) > ln(1.15::DOUBLE) THEN 3 WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS raw FROM d),
v AS (SELECT *, count(*) FILTER (raw = 0) OVER w AS v0, count(*) FILTER (raw = 1) OVER w AS v1, count(*) FILTER (raw = 2) OVER w AS v2, count(*) FILTER (raw = 3) OVER w AS v3 FROM l WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
f AS (SELECT *, CASE WHEN v0 >= v1 AND v0 >= v2 AND v0 >= v3 THEN 0 WHEN v1 >= v2 AND v1 >= v3 THEN 1 WHEN v2 >= v3 THEN 2 ELSE 3 END AS vote FROM v),
lv AS (SELECT user_id, t, n, mapped, step IS NULL AS final, CASE WHEN c < 4 THEN 3 WHEN step IS NULL THEN lag(vote) OVER (PARTITION BY user_id ORDER BY t) ELSE vote END AS level FROM f)"""


def _beats(spark, sf_dir):
    e = events(spark, sf_dir).groupBy("user_id", "t").agg(F.min("event_id").alias("event_id"), F.max((F.col("event_type") == "view") & (F.col("value") > 50)).alias("bad"))
    line = Window.partitionBy("user_id").orderBy("t")
    b = e.withColumn("n", F.row_number().over(line) - 1)
    step = F.get(F.array(*[F.lit(float(x)) for x in (0.5, 1, 2, 1.5)]), ((F.col("user_id") + F.floor(F.col("n") / 7)) % 4).cast("int"))
    mapped = F.sum(step).over(line) + (F.col("event_id") % 7 - 3) / 64.0
    return b.select("user_id", "t", "n", mapped.alias("mapped"), (~F.col("bad")).alias("usable"))


@query("beat_align_levels", _sql("{EV}" + _BEATS + _LEVELS + " SELECT user_id, t, level FROM lv"))
def beat_align_levels(spark, sf_dir):
    return grids.align_levels(_beats(spark, sf_dir), ["user_id"], "t", "mapped", "usable").select("user_id", "t", "level")


@query("beat_relevel", _sql("{EV}" + _BEATS + _LEVELS + """,
h AS (SELECT *, n - row_number() OVER (PARTITION BY user_id ORDER BY n) AS run FROM lv WHERE level = 0 AND NOT final),
h2 AS (SELECT *, (row_number() OVER (PARTITION BY user_id, run ORDER BY n) - 1) % 2 AS side FROM h),
o AS (SELECT user_id, run, side, avg(abs(mapped - round_even(mapped, 0))) AS off FROM h2 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY off, side) AS nth FROM o),
g AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS nxt FROM lv)
SELECT h2.user_id, h2.t::DOUBLE AS t, h2.level, false AS added FROM h2 JOIN k ON k.user_id = h2.user_id AND k.run = h2.run AND k.side = h2.side AND k.nth = 1
UNION ALL SELECT user_id, t::DOUBLE, level, false FROM lv WHERE level <> 0 OR final
UNION ALL SELECT user_id, (t + nxt) / 2.0::DOUBLE, level, true FROM g WHERE level = 2 AND nxt IS NOT NULL"""))
def beat_relevel(spark, sf_dir):
    levels = grids.align_levels(_beats(spark, sf_dir), ["user_id"], "t", "mapped", "usable")
    return grids.relevel(levels, ["user_id"], "t", "mapped", "level")


@query("level_grids", _sql("""{EV}, b AS (SELECT DISTINCT user_id, t, t // 604800 AS bar FROM ev), s AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS nxt, row_number() OVER (PARTITION BY user_id, bar ORDER BY t) AS n, count(*) OVER (PARTITION BY user_id, bar) AS c FROM b)
SELECT user_id, level, t FROM (
  SELECT user_id, 2.0::DOUBLE AS level, unnest(CASE WHEN nxt IS NULL THEN [t::DOUBLE] ELSE [t::DOUBLE, t + (nxt - t) / 2.0::DOUBLE] END) AS t FROM s
  UNION ALL SELECT user_id, 3.0::DOUBLE, unnest(CASE WHEN nxt IS NULL THEN [t::DOUBLE] ELSE [t::DOUBLE, t + (nxt - t) * 1 / 3.0::DOUBLE, t + (nxt - t) * 2 / 3.0::DOUBLE] END) FROM s
  UNION ALL SELECT user_id, 0.5::DOUBLE, t::DOUBLE FROM s WHERE n % 2 = 1 AND user_id NOT IN (SELECT user_id FROM s WHERE c % 2 = 1))"""))
def level_grids(spark, sf_dir):
    beats = _kind(spark, sf_dir).withColumn("bar", F.floor(F.col("t") / 604_800))
    each = [grids.level_grid(beats, ["user_id"], "t", "bar", x).withColumn("level", F.lit(float(x))) for x in (2, 3, 0.5)]
    return each[0].unionByName(each[1]).unionByName(each[2]).select("user_id", "level", "t")


LENGTHS = scalar.duration_values(4, 12, 400)


@query("pedal_safe_bins", _sql("""{EV}, c AS (SELECT DISTINCT user_id, t // 600 AS moment FROM ev WHERE event_type IN ('signup', 'error')),
d AS (SELECT event_id, user_id, t // 600 AS onset, 1 + event_id % 397 AS duration FROM ev WHERE event_type NOT IN ('signup', 'error')),
v AS (SELECT unnest({LENGTHS}) AS v, unnest(range(0, {N})) AS i),
b AS (SELECT event_id, count(*) FILTER (sqrt(v.v * w.v) < d.duration) AS near FROM d, v JOIN v w ON w.i = v.i + 1 GROUP BY event_id),
n AS (SELECT d.*, b.near, (SELECT max(moment) FROM c WHERE c.user_id = d.user_id AND moment < onset + duration) AS low, (SELECT min(moment) FROM c WHERE c.user_id = d.user_id AND moment >= onset + duration) AS high FROM d JOIN b USING (event_id)),
w AS (SELECT n.event_id, n.near, v.i, abs(v.v - n.duration) AS far, (low IS NULL OR onset + v.v > low) AND (high IS NULL OR onset + v.v <= high) AS ok FROM n, v),
k AS (SELECT event_id, arg_min(i, far * 1000 + i) FILTER (ok) AS best, bool_or(ok AND i = near) AS fine, any_value(near) AS near FROM w GROUP BY event_id)
SELECT event_id, CASE WHEN fine THEN near ELSE coalesce(best, near) END::INTEGER AS bin FROM k""").replace("{LENGTHS}", repr(LENGTHS)).replace("{N}", str(len(LENGTHS))))
def pedal_safe_bins(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("at", F.floor(F.col("t") / 600))
    pedal = F.col("event_type").isin("signup", "error")
    rows = e.where(~pedal).select("event_id", "user_id", F.col("at").alias("onset"), (1 + F.col("event_id") % 397).alias("duration"))
    return notes.pedal_safe_bins(rows, e.where(pedal).select("user_id", "at"), ["user_id"], "onset", "duration", "at", LENGTHS).select("event_id", "bin")


# ---- comparison of two sides ---------------------------------------------------------------------------------

def _side(spark, sf_dir, kind: str):
    """A kind's events as attacks: hours, one of three pitches, a length and a staff."""
    e = events(spark, sf_dir, kind)
    return e.select("user_id", F.floor(F.col("t") / 3600).alias("t"), (F.col("event_id") % 3).alias("p"), F.floor(F.col("value") / 20).alias("length"), (F.col("event_id") % 2).alias("staff"))


@query("local_f1", _sql("""{EV}, a AS (SELECT DISTINCT user_id, t // 3600 AS t, event_id % 3 AS p FROM ev WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id, t // 3600 AS t, event_id % 3 AS p FROM ev WHERE event_type = 'view'),
s AS (SELECT unnest(range(-24, 25, 2)) AS s), o AS (SELECT user_id, t // 96 AS w, count(*) AS n FROM a GROUP BY ALL),
m AS (SELECT user_id, (t + s) // 96 AS w, s, count(*) AS m FROM b, s WHERE t + s >= 0 GROUP BY ALL),
h AS (SELECT a.user_id, a.t // 96 AS w, s, count(*) AS h FROM a JOIN b ON a.user_id = b.user_id AND a.p = b.p JOIN s ON b.t + s.s = a.t GROUP BY ALL),
f AS (SELECT o.user_id, o.w, o.n, max(coalesce(2.0::DOUBLE * h.h / (o.n + m.m), 0)) AS f FROM o LEFT JOIN h ON h.user_id = o.user_id AND h.w = o.w LEFT JOIN m ON m.user_id = o.user_id AND m.w = o.w AND m.s = h.s GROUP BY ALL)
SELECT user_id, round_even(sum(f * n) / sum(n), 9) AS local_f1 FROM f GROUP BY user_id"""))
def local_f1(spark, sf_dir):
    f = align.local_f1(_side(spark, sf_dir, "click"), _side(spark, sf_dir, "view"), ["user_id"], "t", ["p"], 96, 24, 2)
    return f.select("user_id", F.bround("local_f1", 9).alias("local_f1"))


@query("score_agreement", _sql("""{EV}, a AS (SELECT user_id, t // 86400 AS t, event_id % 3 AS p, max(floor(value / 20))::BIGINT AS length FROM ev WHERE event_type = 'click' GROUP BY ALL),
b AS (SELECT user_id, t // 86400 AS t, event_id % 3 AS p, max(floor(value / 20))::BIGINT AS length FROM ev WHERE event_type = 'view' GROUP BY ALL)
SELECT coalesce(a.user_id, b.user_id) AS user_id, count(a.t) AS n_reference, count(b.t) AS n_other, count(*) FILTER (a.t IS NOT NULL AND b.t IS NOT NULL) AS n_matched,
  round_even(2.0::DOUBLE * count(*) FILTER (a.t IS NOT NULL AND b.t IS NOT NULL) / (count(a.t) + count(b.t)), 9) AS attack_f1,
  round_even(count(*) FILTER (a.length = b.length)::DOUBLE / greatest(count(*) FILTER (a.t IS NOT NULL AND b.t IS NOT NULL), 1), 9) AS length
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.t = b.t AND a.p = b.p GROUP BY ALL"""))
def score_agreement(spark, sf_dir):
    sides = [_side(spark, sf_dir, k).withColumn("t", F.floor(F.col("t") / 24)) for k in ("click", "view")]
    r = align.agreement(*sides, ["user_id"], "t", ["p"], ["length"])
    return r.select("user_id", "n_reference", "n_other", "n_matched", F.bround("attack_f1", 9).alias("attack_f1"), F.bround("length", 9).alias("length"))


@query("uncovered_time", _sql("""{EV}, c AS (SELECT DISTINCT user_id, t // 3600 AS a FROM ev WHERE event_type = 'click'), d AS (SELECT user_id, unnest(range(a, a + 30)) AS h FROM c), f AS (SELECT DISTINCT user_id, h FROM d),
r AS (SELECT user_id, min(t) // 3600 AS low, max(t) // 3600 + 1 AS high FROM ev GROUP BY user_id), b AS (SELECT DISTINCT user_id, t // 3600 AS at FROM ev WHERE event_type = 'view')
SELECT b.user_id, b.at, (least(greatest(b.at, low), high) - low - (SELECT count(*) FROM f WHERE f.user_id = b.user_id AND f.h >= low AND f.h < least(b.at, high)))::BIGINT AS gap FROM b JOIN r USING (user_id)"""))
def uncovered_time(spark, sf_dir):
    """Hours before each view of a user that no click's thirty hours cover."""
    from ..operators.temporal import merge_intervals

    e = events(spark, sf_dir).withColumn("h", F.floor(F.col("t") / 3600))
    spans = e.where("event_type = 'click'").select("user_id", F.col("h").alias("a"), (F.col("h") + 30).alias("b"))
    whole = e.groupBy("user_id").agg(F.min("h").alias("low"), (F.max("h") + 1).alias("high"))
    bounds = e.where("event_type = 'view'").select("user_id", F.col("h").alias("at")).distinct().join(whole, "user_id")
    return align.uncovered(bounds, merge_intervals(spans, ["user_id"], "a", "b"), ["user_id"], "at", "a", "b", "low", "high").select("user_id", "at", "gap")


@query("arrangement_features", _sql("""{EV}, c AS (SELECT user_id, t // 7200 AS onset, 48 + event_id % 36 AS pitch, t // 3600 AS m FROM ev WHERE event_type IN ('view', 'click', 'purchase')),
w AS (SELECT user_id, min(m) AS f, max(m) AS l FROM c GROUP BY user_id HAVING count(*) >= 10),
mel AS (SELECT event_id, user_id, t // 3600 AS start, event_id % 40 AS dur, 40 + event_id % 40 AS pitch FROM ev WHERE event_type = 'error'),
s AS (SELECT DISTINCT user_id, unnest(range(start, start + greatest(dur, 2))) AS h FROM mel),
g0 AS (SELECT user_id, unnest(range(f, l + 1)) AS h FROM w), g AS (SELECT g0.* FROM g0 LEFT JOIN s ON s.user_id = g0.user_id AND s.h = g0.h WHERE s.h IS NULL),
b0 AS (SELECT DISTINCT user_id, t // 3600 AS low FROM ev WHERE event_type = 'signup'), b AS (SELECT * FROM (SELECT user_id, low, lead(low) OVER (PARTITION BY user_id ORDER BY low) AS high FROM b0) WHERE high IS NOT NULL),
p AS (SELECT b.user_id, b.low, count(*) AS pause FROM b JOIN g ON g.user_id = b.user_id AND g.h >= b.low AND g.h < b.high GROUP BY ALL),
ch AS (SELECT c.user_id, c.onset, min(c.m) AS m FROM c JOIN g ON g.user_id = c.user_id AND g.h = c.m WHERE c.pitch >= 60 GROUP BY ALL),
fi AS (SELECT b.user_id, b.low, count(*) AS n FROM b JOIN ch ON ch.user_id = b.user_id AND ch.m >= b.low AND ch.m < b.high GROUP BY ALL),
ne AS (SELECT mel.event_id, mel.user_id, mel.start, max(c.pitch) AS top, max(c.pitch) FILTER (c.pitch % 12 = mel.pitch % 12) AS same FROM mel JOIN w ON w.user_id = mel.user_id AND mel.start BETWEEN f AND l JOIN c ON c.user_id = mel.user_id AND abs(c.m - mel.start) <= 24 GROUP BY ALL),
ab AS (SELECT b.user_id, b.low, count(*) AS n, count(*) FILTER (top > same) AS above FROM b JOIN ne ON ne.user_id = b.user_id AND ne.start >= b.low AND ne.start < b.high WHERE same IS NOT NULL GROUP BY ALL),
re AS (SELECT b.user_id, b.low, count(*) AS n, max(pitch) - min(pitch) AS span FROM b JOIN c ON c.user_id = b.user_id AND c.m >= b.low AND c.m < b.high GROUP BY ALL)
SELECT b.user_id, b.low, b.high, round_even(CASE WHEN w.f IS NOT NULL AND p.pause >= 6 THEN ln(1 + coalesce(fi.n, 0) / (p.pause / 2.0::DOUBLE)) END, 9) AS fill,
  round_even(CASE WHEN w.f IS NOT NULL AND ab.n >= 2 THEN sqrt(ab.above / ab.n::DOUBLE) END, 9) AS above, CASE WHEN w.f IS NOT NULL AND re.n >= 2 THEN (re.span - 38.0::DOUBLE) / 4.0::DOUBLE END AS span
FROM b LEFT JOIN w ON w.user_id = b.user_id LEFT JOIN p ON p.user_id = b.user_id AND p.low = b.low LEFT JOIN fi ON fi.user_id = b.user_id AND fi.low = b.low
LEFT JOIN ab ON ab.user_id = b.user_id AND ab.low = b.low LEFT JOIN re ON re.user_id = b.user_id AND re.low = b.low"""))
def arrangement_features(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("h", F.floor(F.col("t") / 3600))
    cover = e.where("event_type in ('view', 'click', 'purchase')").select("user_id", F.floor(F.col("t") / 7200).alias("onset"), (48 + F.col("event_id") % 36).alias("pitch"), F.col("h").alias("mapped"))
    melody = e.where("event_type = 'error'").select("user_id", F.col("h").alias("start"), (F.col("event_id") % 40).alias("duration"), (40 + F.col("event_id") % 40).alias("pitch"))
    ends = e.where("event_type = 'signup'").select("user_id", F.col("h").alias("low")).distinct()
    spans = ends.withColumn("high", F.lead("low").over(Window.partitionBy("user_id").orderBy("low"))).where("high is not null")
    r = arrangement.arrangement(cover, melody, spans, ["user_id"], 24, shortest=2, least_gap=3.0, least_melody=2, least_notes=2, unit=2.0, scores={"span": (38.0, 4.0)})
    return r.select("user_id", "low", "high", F.bround("fill", 9).alias("fill"), F.bround("above", 9).alias("above"), "span")


# ---- the grid of bars ----------------------------------------------------------------------------------------

def _bars(spark, sf_dir):
    """Bars of 154, 154 and 124 ticks in turn, for each user."""
    users = events(spark, sf_dir).select("user_id").distinct()
    return users.withColumn("bar", F.explode(F.sequence(F.lit(0), F.lit(40)))).withColumn("start", 144 * F.col("bar") + 10 * (F.col("bar") % 3))


def _ticks(spark, sf_dir):
    """Events as rows on ticks: signups and errors press and release a pedal, the others are notes, one at a tick and pitch."""
    kind = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", 0).otherwise(2)
    rows = events(spark, sf_dir).select("user_id", F.floor(F.col("t") / 600).alias("onset"), kind.alias("kind"), "event_id")
    note = F.col("kind") == 2
    return rows.select("user_id", "onset", "kind", *[F.when(note, c).otherwise(0).alias(n) for n, c in (("pitch", 21 + F.col("event_id") % 88), ("duration", 1 + F.col("event_id") % 300), ("velocity", 1 + F.col("event_id") % 127))]).distinct()


@query("bar_round_trip", _sql("""{EV} SELECT DISTINCT user_id, t // 600 AS onset, CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 0 ELSE 2 END AS kind,
  CASE WHEN event_type IN ('signup', 'error') THEN 0 ELSE 21 + event_id % 88 END AS pitch, CASE WHEN event_type IN ('signup', 'error') THEN 0 ELSE 1 + event_id % 300 END AS duration, CASE WHEN event_type IN ('signup', 'error') THEN 0 ELSE 1 + event_id % 127 END AS velocity FROM ev"""))
def bar_round_trip(spark, sf_dir):
    b = _bars(spark, sf_dir)
    return bars.bar_detokenise(bars.bar_tokenise(_ticks(spark, sf_dir), b, ["user_id"], 160), b, ["user_id"], 160)


@query("bar_tokens", _sql("""{EV}, b AS (SELECT user_id, bar, 144 * bar + 10 * (bar % 3) AS start FROM (SELECT DISTINCT user_id FROM ev), (SELECT unnest(range(0, 41)) AS bar)),
r AS (SELECT DISTINCT user_id, t // 600 AS onset, CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 0 ELSE 2 END AS kind, CASE WHEN event_type IN ('signup', 'error') THEN NULL ELSE event_id END AS e FROM ev),
p AS (SELECT r.*, max(b.bar) AS bar, max(b.start) AS start FROM r JOIN b ON b.user_id = r.user_id AND b.start <= r.onset GROUP BY ALL),
k AS (SELECT user_id, bar, count(*) AS n, count(DISTINCT onset) AS times, count(*) FILTER (kind = 2) AS notes FROM p GROUP BY ALL)
SELECT k.user_id, k.bar, (times + notes * 3 + n + 1)::BIGINT AS size, coalesce((SELECT arg_max(kind = 1, onset * 2 + kind) FROM r WHERE r.user_id = k.user_id AND kind < 2 AND onset < b.start), false) AS pedal FROM k JOIN b ON b.user_id = k.user_id AND b.bar = k.bar"""))
def bar_tokens(spark, sf_dir):
    found = bars.bar_tokenise(_ticks(spark, sf_dir), _bars(spark, sf_dir), ["user_id"], 160)
    return found.select("user_id", "bar", F.size("tokens").cast("long").alias("size"), "pedal")


@query("ticks_of_beats", _sql("""{EV}, b0 AS (SELECT DISTINCT user_id, t FROM ev WHERE event_type IN ('click', 'view')), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS n, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS nt, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS pt FROM b0),
x AS (SELECT e.event_id, e.user_id, e.t, (SELECT max(n) FROM b WHERE b.user_id = e.user_id AND b.t <= e.t) AS n FROM ev e WHERE event_type = 'purchase'),
y AS (SELECT x.*, coalesce(x.n, 0) AS k FROM x)
SELECT event_id, CASE WHEN c.user_id IS NULL THEN NULL ELSE round_even((b.n + (y.t - b.t) * coalesce(1.0::DOUBLE / (b.nt - b.t), 1.0::DOUBLE / (b.t - b.pt), 0)) * 12, 0)::BIGINT END AS tick FROM y LEFT JOIN b ON b.user_id = y.user_id AND b.n = y.k LEFT JOIN (SELECT DISTINCT user_id FROM b) c ON c.user_id = y.user_id"""))
def ticks_of_beats(spark, sf_dir):
    beats = _kind(spark, sf_dir, "click", "view").withColumn("beat", F.row_number().over(Window.partitionBy("user_id").orderBy("t")) - 1)
    rows = events(spark, sf_dir, "purchase").withColumn("t", F.col("t").cast("double"))
    return bars.to_ticks(rows, beats, ["user_id"], "t", 12, "tick").select("event_id", "tick")


# ---- names in SQL, timers ------------------------------------------------------------------------------------

@query("sql_scalars", SQL["score_scalars"])
def sql_scalars(spark, sf_dir):
    """The query score_scalars as SQL text."""
    names.register(spark)
    return spark.sql("""SELECT l_orderkey, l_linenumber, tide_velocity_bin(l_quantity * 3) AS velocity, tide_clock(l_quantity) AS clock, bround(tide_time_bias(l_discount, 0.1D), 9) AS bias,
      bround(tide_meter_length(l_linenumber, 8), 9) AS measure, tide_ledger_lines(l_quantity, 10, 40) AS ledger FROM {lineitem}""", lineitem=table(spark, sf_dir, "lineitem"))


@query("sql_token_events", SQL["token_round_trip"])
def sql_token_events(spark, sf_dir):
    """Tokens decoded by a table function."""
    names.register(spark)
    patches = sequences.tokenise(_notes(spark, sf_dir), ["user_id"], 1440)
    return spark.sql("SELECT p.user_id, e.onset, e.kind, e.pitch, e.duration, e.velocity FROM {patches} p, LATERAL tide_token_events(p.tokens, p.patch, 1440) e", patches=patches)


@query("sql_lcs", _sql("""WITH RECURSIVE """ + """{EV}""" + """,
s AS (SELECT user_id, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS side, event_id % 5 AS x, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS n FROM ev WHERE event_type IN ('click', 'view')),
a AS (SELECT user_id, n AS i, x, count(*) OVER (PARTITION BY user_id) AS na FROM s WHERE side = 0), b AS (SELECT user_id, list(x ORDER BY n) AS ys FROM s WHERE side = 1 GROUP BY user_id),
u AS (SELECT DISTINCT user_id FROM s),
r AS (SELECT u.user_id, 0::BIGINT AS i, list_transform(range(0, coalesce(len(b.ys), 0) + 1), lambda k: 0) AS line, coalesce(b.ys, []) AS ys FROM u LEFT JOIN b ON b.user_id = u.user_id
  UNION ALL SELECT r.user_id, a.i, list_reduce(list_transform(range(1, len(r.ys) + 1), lambda j: [CASE WHEN r.ys[j] = a.x THEN r.line[j] + 1 ELSE r.line[j + 1] END]), lambda p, q: list_append(p, greatest(p[len(p)], q[1])), [0::BIGINT]), r.ys
  FROM r JOIN a ON a.user_id = r.user_id AND a.i = r.i + 1)
SELECT user_id, round_even(2.0::DOUBLE * arg_max(line[len(line)], i) / (max(i) + len(any_value(ys))), 9) AS f1 FROM r GROUP BY user_id""").replace("RECURSIVE WITH ", "RECURSIVE "))
def sql_lcs(spark, sf_dir):
    """A user's clicks against their views, as sequences of one of five values."""
    names.register(spark)
    e = events(spark, sf_dir, "click", "view")
    return spark.sql("SELECT user_id, bround(tide_lcs_f1(IF(event_type = 'click', 0, 1), t * 1000000 + event_id, event_id % 5), 9) AS f1 FROM {e} GROUP BY user_id", e=e)


@query("stream_timed", """WITH n AS (SELECT event_id % 197 AS id, event_id AS seq, event_type AS payload, coalesce(value > 90, false) AS final, ts, max(ts) OVER () - INTERVAL 1 HOUR AS e FROM events),
g AS (SELECT id, min(seq) FILTER (final) AS f, max(seq) AS l, max(ts) AS newest, any_value(e) AS e FROM n GROUP BY id)
SELECT g.id, n.seq, n.payload, CASE WHEN f IS NOT NULL THEN 'final' ELSE 'stalled' END AS status FROM g JOIN n ON n.seq = coalesce(f, l) WHERE f IS NOT NULL OR newest + INTERVAL 5 DAY < g.e""")
def stream_timed(spark, sf_dir):
    """Events as revisions of 197 notes, some of which are final; the others have stalled after five days."""
    timers.prepare(spark)
    source = feeds.read_events(spark, f"{sf_dir}/events*.parquet")
    notes_ = source.select((F.col("event_id") % 197).alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("payload"), F.coalesce(F.col("value") > 90, F.lit(False)).alias("final"), F.col("ts").cast("timestamp").alias("at"))
    return feeds.table_of(timers.timed_revisions(notes_, 5 * 86_400_000, 30 * 86_400_000), "append")
