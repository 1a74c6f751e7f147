"""Queries of source views, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import views
from .catalogue import _kind, _sql, events, query, table

#: Events as rows of a source: clicks and views are notes, purchases beats, signups chords, errors keys.
_ROWS = """{EV}, r AS (SELECT event_id, user_id, t // 60 AS onset, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'error' THEN 3 ELSE 0 END AS type,
  CASE event_type WHEN 'purchase' THEN event_id % 2 WHEN 'signup' THEN event_id % 13 WHEN 'error' THEN event_id % 12 ELSE event_id % 128 END AS a, 1 + event_id % 50 AS b, event_id % 13 AS c, CASE WHEN event_type IN ('click', 'view') THEN event_id % 40 ELSE 0 END AS d FROM ev)"""


def _rows(spark, sf_dir):
    e, x, i = events(spark, sf_dir), F.col("event_type"), F.col("event_id")
    kind = F.when(x == "purchase", 1).when(x == "signup", 2).when(x == "error", 3).otherwise(0)
    a = F.when(x == "purchase", i % 2).when(x == "signup", i % 13).when(x == "error", i % 12).otherwise(i % 128)
    return e.select("event_id", "user_id", F.floor(F.col("t") / 60).alias("onset"), kind.alias("type"), a.alias("a"), (1 + i % 50).alias("b"), (i % 13).alias("c"), F.when(x.isin("click", "view"), i % 40).otherwise(0).alias("d"))


@query("note_predicates", _sql(_ROWS + " SELECT event_id, type = 0 AND d >= 37 AS annotated, type = 0 AND d < 37 AS own FROM r"))
def note_predicates(spark, sf_dir):
    kind, d = F.col("type"), F.col("d")
    return _rows(spark, sf_dir).select("event_id", views.is_annotated(kind, d).alias("annotated"), views.is_own(kind, d).alias("own"))


@query("annotated_rows", _sql(_ROWS + """, x AS (SELECT * FROM r WHERE event_id % 3 = 0), h AS (SELECT DISTINCT user_id FROM x WHERE type = 1 AND user_id % 2 = 0)
SELECT user_id, event_id FROM r WHERE type <> 1 OR user_id NOT IN (SELECT user_id FROM h) UNION ALL SELECT user_id, event_id FROM x WHERE user_id % 2 = 0 AND type IN (0, 1)"""))
def annotated_rows(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return views.with_annotation(rows, rows.where("event_id % 3 = 0 and user_id % 2 = 0"), ["user_id"]).select("user_id", "event_id")


@query("shifted_rows", _sql(_ROWS + """ SELECT event_id, CASE WHEN type = 0 AND d <> 36 THEN a + 5 WHEN type = 2 AND a <> 12 THEN (a + 5) % 12 WHEN type = 3 THEN (a + 5) % 12 ELSE a END AS a, CASE WHEN type = 2 AND c <> 12 THEN (c + 5) % 12 ELSE c END AS c
FROM r WHERE NOT (type = 0 AND d <> 36) OR a + 5 BETWEEN 0 AND 127"""))
def shifted_rows(spark, sf_dir):
    return views.shifted(_rows(spark, sf_dir), 5).select("event_id", "a", "c")


@query("rows_from_first_note", _sql(_ROWS + """, l AS (SELECT user_id, min(onset) AS lead FROM r WHERE type = 0 GROUP BY user_id), j AS (SELECT r.*, lead FROM r LEFT JOIN l ON l.user_id = r.user_id),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, type ORDER BY onset DESC, a DESC, b DESC, c DESC, d DESC) AS n FROM j WHERE onset < lead AND type IN (2, 3)) WHERE n = 1)
SELECT event_id, onset - coalesce(lead, 0) AS onset FROM j WHERE coalesce(onset >= lead, true) UNION ALL SELECT event_id, 0::BIGINT FROM h"""))
def rows_from_first_note(spark, sf_dir):
    return views.from_first_note(_rows(spark, sf_dir), ["user_id"]).select("event_id", "onset")


@query("feature_indexes", _sql(_ROWS + " SELECT event_id, CASE type WHEN 0 THEN 1 + a WHEN 1 THEN 129 + a WHEN 2 THEN 131 + a * 13 + c WHEN 3 THEN 300 + a END::BIGINT AS feature FROM r"))
def feature_indexes(spark, sf_dir):
    a, c = F.col("a"), F.col("c")
    index = views.feature_index(F.col("type"), {0: (1, a), 1: (129, a), 2: (131, a * 13 + c), 3: (300, a)})
    return _rows(spark, sf_dir).select("event_id", index.alias("feature"))


@query("performance_rows", _sql("""{EV}, n AS (SELECT user_id, t, event_type, event_id, greatest(0.02::DOUBLE, least(8.0::DOUBLE, (t + value / 50.0::DOUBLE) - t)) AS s, event_id % 128 AS v FROM ev)
SELECT user_id, t::DOUBLE AS t, 0 AS kind, (event_id % 128)::INT AS pitch, (1 + least(31, floor(ln(s / 0.02::DOUBLE) / ln(400.0::DOUBLE) * 32)))::INT AS length, (1 + least(31, floor(v * 32 / 128)))::INT AS velocity, (event_id % 3 = 0)::INT AS melody FROM n WHERE event_type IN ('click', 'view') AND s IS NOT NULL
UNION ALL SELECT user_id, t::DOUBLE, 1, 0, (1 + least(31, floor(ln(s / 0.02::DOUBLE) / ln(400.0::DOUBLE) * 32)))::INT, 0, 0 FROM n WHERE event_type = 'signup' AND s IS NOT NULL"""))
def performance_rows(spark, sf_dir):
    e = events(spark, sf_dir).where("value is not null").withColumn("start", F.col("t").cast("double")).withColumn("stop", F.col("t") + F.col("value") / 50.0)
    notes = e.where("event_type in ('click', 'view')").withColumns({"pitch": F.col("event_id") % 128, "velocity": F.col("event_id") % 128, "melody": F.col("event_id") % 3 == 0})
    return views.performance_rows(notes, e.where("event_type = 'signup'"), ["user_id"])


@query("transferred_metadata", _sql("""{EV}, m AS (SELECT event_id, user_id, t, event_id % 4 AS track, CASE event_type WHEN 'purchase' THEN 'tempo' WHEN 'signup' THEN 'lyric' WHEN 'error' THEN 'marker' ELSE 'note' END AS what FROM ev),
a AS (SELECT * FROM m WHERE event_id % 2 = 0), b AS (SELECT * FROM m WHERE event_id % 2 = 1 AND user_id % 3 <> 0), h AS (SELECT DISTINCT user_id FROM b)
SELECT event_id, track FROM a WHERE what = 'note' OR user_id NOT IN (SELECT user_id FROM h) UNION ALL SELECT event_id, CASE WHEN what = 'lyric' THEN 0 ELSE track END FROM b WHERE what <> 'note' AND user_id IN (SELECT user_id FROM a)"""))
def transferred_metadata(spark, sf_dir):
    x = F.col("event_type")
    what = F.when(x == "purchase", "tempo").when(x == "signup", "lyric").when(x == "error", "marker").otherwise("note")
    m = events(spark, sf_dir).select("event_id", "user_id", "t", (F.col("event_id") % 4).alias("track"), what.alias("what"))
    return views.transfer(m.where("event_id % 2 = 0"), m.where("event_id % 2 = 1 and user_id % 3 <> 0"), ["user_id"], ["tempo", "marker"]).select("event_id", "track")


_DRAW = "('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query("varied_tempo", _sql("""{EV}, b AS (SELECT DISTINCT user_id, t FROM ev), s AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t), 0) * 1.1::DOUBLE AS step, """ + _DRAW.format("'9|' || user_id || '|' || t || '|u'") + " AS u, " + _DRAW.format("'9|' || user_id || '|' || t || '|v'") + """ AS v FROM b)
SELECT user_id, t, round_even(sum(step * exp(0.05::DOUBLE * (sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - u)) * cos(2.0::DOUBLE * pi() * v)))) OVER (PARTITION BY user_id ORDER BY t), 3) AS varied FROM s"""))
def varied_tempo(spark, sf_dir):
    r = views.vary_tempo(_kind(spark, sf_dir), ["user_id"], "t", "t", 1.1, 0.05, 9)
    return r.select("user_id", "t", F.bround("varied", 3).alias("varied"))


@query("perturbed_events", _sql("""{EV}, s0 AS (SELECT user_id, (max(t) // 604800)::INT AS patches, """ + _DRAW.format("'4|' || user_id || '|song'") + " AS a, " + _DRAW.format("'4|' || user_id || '|split'") + " AS b, " + _DRAW.format("'4|' || user_id || '|shift'") + """ AS c FROM ev GROUP BY user_id),
s AS (SELECT user_id, patches, CASE WHEN patches >= 4 AND a < 0.5::DOUBLE THEN 2 + floor(b * (greatest(2, patches // 2) - 1))::INT END AS split, CASE WHEN patches >= 4 AND a < 0.5::DOUBLE THEN round_even((2 * c - 1) * 90000, 0)::BIGINT END AS shift FROM s0)
SELECT event_id, CASE WHEN t < split * 604800 THEN greatest(0, t + shift) ELSE t END AS onset, s.patches - CASE WHEN split IS NULL THEN 0 ELSE least(split, patches) END AS n_loss FROM ev JOIN s ON s.user_id = ev.user_id"""))
def perturbed_events(spark, sf_dir):
    e = events(spark, sf_dir)
    songs = e.groupBy("user_id").agg(F.floor(F.floor(F.max("t") / 86_400) / 7).cast("int").alias("patches"))
    moved, told = views.perturbed_context(e.select("event_id", "user_id", F.col("t").alias("onset")), songs, ["user_id"], 604_800, 0.5, 90_000, 4)
    n = F.size(F.filter("loss", lambda x: x))
    return moved.join(told.select("user_id", n.alias("n_loss")), "user_id").select("event_id", "onset", "n_loss")


@query("rescaled_metronome", f"""WITH m AS (SELECT unnest({list(scalar.METRONOME)!r}) AS m), x AS (SELECT DISTINCT l_quantity FROM lineitem) SELECT l_quantity, arg_min(m, abs(m - (40 + l_quantity * 3) / 1.07::DOUBLE) * 1000 + m / 1000000.0::DOUBLE) AS mark FROM x, m GROUP BY l_quantity""")
def rescaled_metronome(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_quantity").distinct()
    return x.select("l_quantity", views.rescaled_metronome(40 + F.col("l_quantity") * 3, 1.07).alias("mark"))


@query("chosen_songs", """SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING max(l_quantity) - min(l_quantity) >= 39) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)""")
def chosen_songs(spark, sf_dir):
    good = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") < 0).alias("low")), "o_custkey").select("o_orderkey", "low")
    spans = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.max("l_quantity") - F.min("l_quantity")).alias("span"))
    return views.chosen_songs(table(spark, sf_dir, "orders").select("o_orderkey"), good, spans, ["o_orderkey"], 39)
