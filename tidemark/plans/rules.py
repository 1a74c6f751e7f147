"""Queries of rules, measures and small operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import axis, buckets, corpus, sampling, sequences, series
from .catalogue import _kind, _notes, _sql, events, query, table
from .choices import STEPS


# ---- measures ------------------------------------------------------------------------------------------------

_MEASURES = """WITH m0 AS (SELECT conv_id, turn, min(length(text)) AS n FROM conversations GROUP BY ALL),
m1 AS (SELECT conv_id, turn, (1 + n % 8) / 2.0::DOUBLE AS length, CASE WHEN n % 3 = 0 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS unit FROM m0),
m AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM m1)"""


def _measures(spark, sf_dir):
    """A conversation's turns as measures of half a quarter to four, in beats of one or one and a half."""
    m = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min(F.length("text")).alias("n"))
    m = m.select("conv_id", "turn", ((1 + F.col("n") % 8) / 2.0).alias("length"), F.when(F.col("n") % 3 == 0, 1.5).otherwise(1.0).alias("unit"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return m.withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0.0)))


@query("measure_beats", _MEASURES + """, n AS (SELECT *, length < 3 AS short, CASE WHEN length < 3 THEN floor((length + 0.015625::DOUBLE) / unit) ELSE ceil((length - 0.015625::DOUBLE) / unit) END::INT AS k FROM m),
b AS (SELECT *, unnest(range(0, k))::INT AS beat FROM n) SELECT conv_id, turn, beat, CASE WHEN short THEN start + length - (k - beat) * unit ELSE start + beat * unit END AS position FROM b""")
def measure_beats(spark, sf_dir):
    m = _measures(spark, sf_dir).withColumn("nominal", F.lit(3.0))
    return axis.beats_of_measures(m, ["conv_id"], "turn", "start", "length", "nominal", "unit")


@query("measure_tempo", _MEASURES + """, s AS (SELECT *, start * (1 + turn % 3) / 2.0::DOUBLE AS sec FROM m), d AS (SELECT *, lead(sec) OVER (PARTITION BY conv_id ORDER BY turn) - sec AS span FROM s),
q AS (SELECT *, CASE WHEN span > 0 THEN length * 60 / greatest(span, 0.000001::DOUBLE) WHEN span IS NOT NULL THEN 120.0::DOUBLE END AS q FROM d)
SELECT conv_id, turn, round_even(greatest(20, least(400, coalesce(q, lag(q) OVER (PARTITION BY conv_id ORDER BY turn), 120))), 9) AS qpm FROM q""")
def measure_tempo(spark, sf_dir):
    m = _measures(spark, sf_dir).withColumn("sec", F.col("start") * (1 + F.col("turn") % 3) / 2.0)
    return axis.measure_tempo(m, ["conv_id"], "turn", "sec", "length").select("conv_id", "turn", F.bround("qpm", 9).alias("qpm"))


@query("match_by_measure", _sql("""{EV}, m0 AS (SELECT DISTINCT user_id, t / 3600.0::DOUBLE AS start FROM ev WHERE event_type = 'error'), m1 AS (SELECT *, row_number() OVER w - 1 AS measure, lead(start) OVER w - start AS d, count(*) OVER (PARTITION BY user_id) AS n FROM m0 WINDOW w AS (PARTITION BY user_id ORDER BY start)),
m2 AS (SELECT *, 1.0::DOUBLE + measure % 4 AS length FROM m1 WHERE n > 1), m AS (SELECT *, coalesce(d, lag(d) OVER w * length / lag(length) OVER w) AS dd FROM m2 WINDOW w AS (PARTITION BY user_id ORDER BY measure)),
s AS (SELECT event_id, user_id, event_id % 9 AS measure, (event_id % 8) / 8.0::DOUBLE AS onset, event_id % 3 AS p FROM ev WHERE event_type = 'click'), v AS (SELECT user_id, t / 3600.0::DOUBLE AS t, event_id % 3 AS p FROM ev WHERE event_type = 'view'),
x AS (SELECT s.event_id, m.user_id, m.measure, s.p, start + onset / length * dd AS t, greatest(0.1::DOUBLE, 0.12::DOUBLE * dd) AS tol FROM s JOIN m ON m.user_id = s.user_id AND m.measure = s.measure),
f AS (SELECT x.event_id, x.user_id, x.measure, bool_or(abs(v.t - x.t) <= tol) AS hit FROM x LEFT JOIN v ON v.user_id = x.user_id AND v.p = x.p GROUP BY ALL)
SELECT m.user_id, m.measure, count(*) FILTER (hit) AS found, count(f.event_id) AS total FROM m LEFT JOIN f ON f.user_id = m.user_id AND f.measure = m.measure GROUP BY ALL"""))
def match_by_measure(spark, sf_dir):
    starts = _kind(spark, sf_dir, "error").select("user_id", (F.col("t") / 3600.0).alias("start"))
    m = starts.withColumn("measure", (F.row_number().over(Window.partitionBy("user_id").orderBy("start")) - 1).cast("long")).withColumn("length", 1.0 + F.col("measure") % 4)
    score = events(spark, sf_dir, "click").select("user_id", (F.col("event_id") % 9).alias("measure"), ((F.col("event_id") % 8) / 8.0).alias("onset"), (F.col("event_id") % 3).alias("pitch"))
    played = events(spark, sf_dir, "view").select("user_id", (F.col("t") / 3600.0).alias("t"), (F.col("event_id") % 3).alias("pitch"))
    return axis.match_by_measure(score, m, played, ["user_id"])


@query("consecutive_beats", _sql("""{EV}, b AS (SELECT user_id, t, event_id, value > 20 AS ok FROM ev), c AS (SELECT *, coalesce(ok, false) AS o, coalesce(ok, false) AND coalesce(lag(ok) OVER (PARTITION BY user_id ORDER BY t, event_id), false) AS pair FROM b)
SELECT user_id, count(*) AS n, round_even(avg(o::INT), 9) AS ok, count(*) FILTER (pair) AS consecutive FROM c GROUP BY user_id"""))
def consecutive_beats(spark, sf_dir):
    r = axis.consecutive(events(spark, sf_dir).withColumn("ok", F.col("value") > 20), ["user_id"], ["t", "event_id"], "ok")
    return r.select("user_id", "n", F.bround("ok", 9).alias("ok"), "consecutive")


# ---- scalars -------------------------------------------------------------------------------------------------

@query("log_steps", f"""WITH v AS (SELECT unnest({STEPS[1:]!r}::DOUBLE[]) AS v, unnest(range(1, {len(STEPS)})) AS i), x AS (SELECT DISTINCT l_quantity, l_discount, l_quantity * l_discount * l_discount * 3 AS x FROM lineitem)
SELECT l_quantity, l_discount, CASE WHEN any_value(x) < 0.01::DOUBLE THEN 0 ELSE arg_min(i, abs(ln(v) - ln(x))) END::INTEGER AS bin FROM (SELECT l_quantity, l_discount, x, v, i FROM x, v) GROUP BY l_quantity, l_discount""")
def log_steps(spark, sf_dir):
    q = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount").distinct()
    x = F.col("l_quantity") * F.col("l_discount") * F.col("l_discount") * 3
    return q.select("l_quantity", "l_discount", scalar.log_step_bin(x, STEPS).alias("bin"))


@query("written_fractions", f"""WITH x AS (SELECT DISTINCT l_suppkey * 7 + l_linenumber AS p, [160, 96, 480, 7, 1, 120, 1024][l_linenumber]::BIGINT AS d FROM lineitem), q AS (SELECT unnest({list(scalar.WRITTEN)!r}) AS q),
g AS (SELECT *, p // gcd(p, d) AS num, d // gcd(p, d) AS den FROM x), w AS (SELECT p, d, q, round_even(p * q / d::DOUBLE, 0)::BIGINT AS r FROM g, q WHERE d % q <> 0 AND den NOT IN {scalar.WRITTEN}),
n AS (SELECT p, d, min(q) AS q FROM w WHERE 32 * abs(r * d - p * q) <= least(96 * q, q * d) GROUP BY ALL), b AS (SELECT n.p, n.d, n.q, w.r FROM n JOIN w ON w.p = n.p AND w.d = n.d AND w.q = n.q)
SELECT g.p, g.d, coalesce(b.r // gcd(b.r, b.q), g.num) AS num, coalesce(b.q // gcd(b.r, b.q), g.den)::BIGINT AS den FROM g LEFT JOIN b ON b.p = g.p AND b.d = g.d""")
def written_fractions(spark, sf_dir):
    divisions = F.element_at(F.array(*[F.lit(x) for x in (160, 96, 480, 7, 1, 120, 1024)]), F.col("l_linenumber")).cast("long")
    x = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 7 + F.col("l_linenumber")).cast("long").alias("p"), divisions.alias("d")).distinct()
    return x.select("p", "d", scalar.written_fraction(F.col("p"), F.col("d")).alias("f")).select("p", "d", "f.num", "f.den")


@query("error_keys", """SELECT CASE WHEN starts_with(text, 'The') THEN 'text: ' || array_to_string(string_split(text, ' ')[1:2], ' ') ELSE 'text: ' || string_split(text, ' ')[1] END AS reason, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL""")
def error_keys(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.groupBy(scalar.error_key(F.col("text"), "text: ", ["The"]).alias("reason")).agg(F.count("*").alias("n"))


@query("crc_split", """WITH RECURSIVE c AS (SELECT i AS b, i AS c, 0 AS k FROM (SELECT unnest(range(0, 256))::BIGINT AS i) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM c WHERE k < 8),
t AS (SELECT list(c ORDER BY b) AS t FROM c WHERE k = 8), d AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)), lambda h, x: xor(h >> 8, t[(xor(h, x) & 255) + 1])), 4294967295::BIGINT) % 10000 / 100.0::DOUBLE AS b FROM d, t)
SELECT doc_id, CASE WHEN b < 5 THEN 1 WHEN b < 10 THEN 2 ELSE 0 END AS split FROM documents JOIN s USING (doc_id)""")
def crc_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", corpus.split_of(F.col("doc_id"), 5.0, 5.0).alias("split"))


# ---- small operators -----------------------------------------------------------------------------------------

@query("carried_values", _sql("""{EV} SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS held FROM ev"""))
def carried_values(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("x", F.when(F.col("event_type") == "purchase", F.col("value")))
    return series.carry(e, ["user_id"], ["t", "event_id"], "x", "held").select("event_id", "held")


@query("first_rows", _sql("""{EV} SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, t // 604800 ORDER BY t, event_id) AS n FROM ev) WHERE n <= 3"""))
def first_rows(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("week", F.floor(F.col("t") / 604_800))
    return series.first_rows(e, ["user_id", "week"], ["t", "event_id"], 3).select("event_id")


_MASKS = """{EV}, m AS (SELECT user_id, t // 86400 AS day, bit_or(1::BIGINT << (event_id % 12)::INT) AS mask FROM ev GROUP BY ALL)"""


@query("onset_masks", _sql(_MASKS + " SELECT user_id, day, mask::INTEGER AS mask FROM m"))
def onset_masks(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", F.floor(F.col("t") / 86_400).alias("day"), (F.col("event_id") % 12).alias("p"))
    return buckets.onset_masks(e, ["user_id"], "day", "p").select("user_id", "day", F.col("mask").cast("int").alias("mask"))


@query("mask_ngrams", _sql(_MASKS + """, w AS (SELECT user_id, mask AS a, lead(mask, 1) OVER o AS b, lead(mask, 2) OVER o AS c, lead(mask, 3) OVER o AS d, lead(mask, 4) OVER o AS e FROM m WINDOW o AS (PARTITION BY user_id ORDER BY day))
SELECT user_id, (a << 48) + (b << 36) + (c << 24) + (d << 12) + e AS gram FROM w WHERE e IS NOT NULL AND NOT (a = b AND b = c AND c = d AND d = e)"""))
def mask_ngrams(spark, sf_dir):
    return corpus.mask_ngrams(onset_masks(spark, sf_dir), ["user_id"], "day", "mask")


@query("masked_mse", """SELECT l_orderkey, round_even(avg(power(CASE WHEN l_linenumber <> 2 THEN l_quantity END - l_tax * 300, 2)), 6) AS mse FROM lineitem GROUP BY ALL""")
def masked_mse(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") != 2, F.col("l_quantity")).alias("a"), (F.col("l_tax") * 300).alias("b"))
    return buckets.masked_mse(li, ["l_orderkey"], "a", "b").select("l_orderkey", F.bround("mse", 6).alias("mse"))


@query("mix_ratio", """WITH t AS (SELECT source, sum(n_chars) AS t FROM documents GROUP BY source) SELECT doc_id, round_even(n_chars * CASE source WHEN 'src0' THEN 0.5::DOUBLE WHEN 'src1' THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END / t, 12) AS weight FROM documents JOIN t USING (source)""")
def mix_ratio(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("n_chars").cast("double").alias("weight"))
    return sampling.mix_ratio(d, "source", "weight", {"src0": 0.5, "src1": 0.3}).select("doc_id", F.bround("weight", 12).alias("weight"))


_UNIT = "('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query("dropped_columns", f"""WITH u AS (SELECT *, {_UNIT.format("'5|' || o_orderkey")} < 0.2::DOUBLE AS whole, {_UNIT.format("'5|' || o_orderkey || '|o_orderstatus'")} < 0.1::DOUBLE AS s, {_UNIT.format("'5|' || o_orderkey || '|o_custkey'")} < 0.1::DOUBLE AS c FROM orders)
SELECT o_orderkey, CASE WHEN NOT whole AND NOT s THEN o_orderstatus END AS o_orderstatus, CASE WHEN NOT whole AND NOT c THEN o_custkey END AS o_custkey FROM u""")
def dropped_columns(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    return sampling.drop_columns(o, "o_orderkey", ["o_orderstatus", "o_custkey"], 0.2, 5)


@query("still_to_do", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def still_to_do(spark, sf_dir):
    return corpus.still_to_do(table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct(), ["o_orderkey"])


@query("weighted_sample", f"""WITH s AS (SELECT {_UNIT.format("'7|start'")} AS s), a AS (SELECT doc_id, source, n_chars, sum(n_chars) OVER (ORDER BY doc_id) AS upto, sum(n_chars) OVER () AS total FROM documents WHERE n_chars > 0),
d AS (SELECT doc_id, source, n_chars, (floor(200 * upto / total::DOUBLE + s) - floor(200 * (upto - n_chars) / total::DOUBLE + s))::BIGINT AS draws FROM a, s) SELECT * FROM d WHERE draws > 0""")
def weighted_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return sampling.weighted_sample(d, "n_chars", ["doc_id"], 200, 7)


@query("pedal_shares", _sql("""{EV}, c AS (SELECT user_id, t, event_id, event_type = 'signup' AS o FROM ev WHERE event_type IN ('signup', 'error')), e AS (SELECT user_id, max(t) AS e FROM ev GROUP BY user_id),
f AS (SELECT user_id, t, o FROM (SELECT *, lag(o) OVER (PARTITION BY user_id ORDER BY t, event_id) AS was FROM c) WHERE coalesce(was <> o, o)),
i AS (SELECT f.user_id, f.t AS a, o, coalesce(lead(f.t) OVER (PARTITION BY f.user_id ORDER BY f.t), e.e) AS b FROM f JOIN e ON e.user_id = f.user_id)
SELECT e.user_id, round_even(coalesce(sum(b - a) FILTER (o), 0) / greatest(any_value(e.e), 1), 9) AS pedal_ratio FROM e LEFT JOIN i ON i.user_id = e.user_id GROUP BY e.user_id"""))
def pedal_shares(spark, sf_dir):
    from ..operators.temporal import toggle_intervals

    e = events(spark, sf_dir)
    ends = e.groupBy("user_id").agg(F.max("t").alias("end"))
    changes = e.where("event_type in ('signup', 'error')").join(ends, "user_id").withColumn("on", F.col("event_type") == "signup")
    held = toggle_intervals(changes, ["user_id"], "t", "on", F.col("end"), ["event_id"])
    return buckets.pedal_share(held, ends, ["user_id"], "start", "stop", "end").select("user_id", F.bround("pedal_ratio", 9).alias("pedal_ratio"))


@query("melody_metrics", _sql("""{EV}, g AS (SELECT user_id, t, event_id % 24 AS p FROM ev WHERE event_type = 'click'), l AS (SELECT user_id, max(t) AS l FROM g GROUP BY user_id),
m AS (SELECT ev.event_id, ev.user_id, t, event_id % 24 AS p FROM ev JOIN l ON l.user_id = ev.user_id AND ev.t <= l WHERE event_type = 'view'),
x AS (SELECT m.event_id, m.user_id, m.p, max(g.p) FILTER (abs(g.t - m.t) <= 40000) AS top, min(abs(g.t - m.t)) FILTER (g.p % 12 = m.p % 12 AND abs(g.t - m.t) <= 200000) AS off FROM m LEFT JOIN g ON g.user_id = m.user_id GROUP BY ALL)
SELECT user_id, count(*) AS n, round_even(avg(CASE WHEN top % 12 = p % 12 THEN 1 ELSE 0 END), 9) AS melody_top, round_even(avg(CASE WHEN off <= 40000 THEN 0 ELSE 1 END), 9) AS melody_late FROM x GROUP BY user_id"""))
def melody_metrics(spark, sf_dir):
    notes = lambda k: events(spark, sf_dir, k).select("user_id", "t", (F.col("event_id") % 24).alias("p"))
    r = buckets.melody_metrics(notes("view"), notes("click"), ["user_id"], "t", "p", 40_000, 200_000)
    return r.select("user_id", "n", F.bround("melody_top", 9).alias("melody_top"), F.bround("melody_late", 9).alias("melody_late"))


@query("grammar_faults", _sql("""{EV}, n AS (SELECT user_id, t // 60 // 1440 AS patch, t // 60 AS onset, CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END AS kind, length(event_type) + 60 AS pitch FROM ev),
d AS (SELECT user_id, patch, onset, kind, CASE WHEN kind = 2 THEN pitch END AS pitch, count(*) AS c FROM n GROUP BY ALL) SELECT user_id, patch, CASE WHEN bool_or(c > 1) THEN 'fault' END AS fault FROM d GROUP BY ALL"""))
def grammar_faults(spark, sf_dir):
    """The tokeniser's own patches: only a pedal pressed twice at once or a pitch struck twice breaks the grammar."""
    found = sequences.first_violation(sequences.tokenise(_notes(spark, sf_dir), ["user_id"], 1440), ["user_id"], 1440)
    return found.select("user_id", "patch", F.when(F.col("violation").isin("kinds out of order", "pitch does not rise"), "fault").otherwise(F.col("violation")).alias("fault"))


# ---- sequences -----------------------------------------------------------------------------------------------

@query("viterbi_modes", _sql("""WITH RECURSIVE """ + """{EV}""" + """,
h AS (SELECT user_id, t // 21600 AS slot, count(*)::DOUBLE AS n FROM ev GROUP BY ALL), s AS (SELECT user_id, slot, row_number() OVER (PARTITION BY user_id ORDER BY slot) AS i, count(*) OVER (PARTITION BY user_id) AS m, [abs(n - 1), abs(n - 3), abs(n - 6)] AS costs FROM h),
p AS (SELECT [[0.0::DOUBLE, 2, 4], [2.0::DOUBLE, 0, 2], [4.0::DOUBLE, 2, 0]] AS p),
f AS (SELECT user_id, i, slot, m, [costs[1], costs[2] + 2, costs[3] + 4] AS cost, [1, 1, 1]::BIGINT[] AS came FROM s WHERE i = 1
  UNION ALL SELECT s.user_id, s.i, s.slot, s.m, list_transform([1, 2, 3], lambda j: s.costs[j] + list_min([f.cost[1] + p[1][j], f.cost[2] + p[2][j], f.cost[3] + p[3][j]])),
    list_transform([1, 2, 3], lambda j: list_position([f.cost[1] + p[1][j], f.cost[2] + p[2][j], f.cost[3] + p[3][j]], list_min([f.cost[1] + p[1][j], f.cost[2] + p[2][j], f.cost[3] + p[3][j]])))
  FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1, p),
b AS (SELECT user_id, i, slot, list_position(cost, list_min(cost))::BIGINT AS mode, came[list_position(cost, list_min(cost))]::BIGINT AS was FROM f WHERE i = m
  UNION ALL SELECT f.user_id, f.i, f.slot, b.was, f.came[b.was]::BIGINT FROM b JOIN f ON f.user_id = b.user_id AND f.i = b.i - 1)
SELECT user_id, slot, (mode - 1)::INTEGER AS mode FROM b""").replace("RECURSIVE WITH ", "RECURSIVE "))
def viterbi_modes(spark, sf_dir):
    h = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") / 21_600).cast("long").alias("slot")).agg(F.count("*").cast("double").alias("n"))
    costs = F.array(F.abs(F.col("n") - 1), F.abs(F.col("n") - 3), F.abs(F.col("n") - 6))
    return sequences.viterbi(h.withColumn("costs", costs), ["user_id"], "slot", "costs", [[0, 2, 4], [2, 0, 2], [4, 2, 0]])


@query("lcs_f1", _sql("""WITH RECURSIVE """ + """{EV}""" + """,
s AS (SELECT user_id, t // 86400 % 2 AS odd, event_type AS x, row_number() OVER (PARTITION BY user_id, t // 86400 % 2 ORDER BY t, event_id) AS n FROM ev),
b AS (SELECT user_id, list(x ORDER BY n) AS ys FROM s WHERE odd = 1 GROUP BY user_id), u AS (SELECT DISTINCT user_id FROM s WHERE odd = 0),
r AS (SELECT u.user_id, 0::BIGINT AS i, list_transform(range(0, len(b.ys) + 1), lambda k: 0) AS line, b.ys FROM u JOIN b ON b.user_id = u.user_id
  UNION ALL SELECT r.user_id, s.n, list_reduce(list_transform(range(1, len(r.ys) + 1), lambda j: [CASE WHEN r.ys[j] = s.x THEN r.line[j] + 1 ELSE r.line[j + 1] END]), lambda p, q: list_append(p, greatest(p[len(p)], q[1])), [0::BIGINT]), r.ys
  FROM r JOIN s ON s.user_id = r.user_id AND s.odd = 0 AND s.n = r.i + 1)
SELECT user_id, round_even(2.0::DOUBLE * arg_max(line[len(line)], i) / (max(i) + len(any_value(ys))), 9) AS f1 FROM r GROUP BY user_id""").replace("RECURSIVE WITH ", "RECURSIVE "))
def lcs_f1(spark, sf_dir):
    e = events(spark, sf_dir).groupBy("user_id", F.pmod(F.floor(F.col("t") / 86400), F.lit(2)).alias("odd")).agg(F.array_sort(F.collect_list(F.struct("t", "event_id", "event_type")))["event_type"].alias("kinds"))
    a, b = e.where("odd = 0").select("user_id", F.col("kinds").alias("a")), e.where("odd = 1").select("user_id", F.col("kinds").alias("b"))
    return sequences.lcs_f1(a.join(b, "user_id"), "a", "b").select("user_id", F.bround("f1", 9).alias("f1"))


@query("tokenise_patches", _sql("""{EV}, n AS (SELECT user_id, t // 60 AS onset, CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END AS kind, event_type, value, event_id FROM ev),
e AS (SELECT user_id, onset // 1440 AS patch, onset, kind, CASE WHEN kind = 2 THEN length(event_type) + 60 ELSE 0 END AS p, CASE WHEN kind = 2 THEN least(1024, CASE WHEN value IS NULL THEN 1 ELSE greatest(1, round_even(value, 0)) END)::BIGINT ELSE 0 END AS d, CASE WHEN kind = 2 THEN event_id % 127 + 1 ELSE 0 END AS v FROM n),
o AS (SELECT *, row_number() OVER w AS i, coalesce(onset <> lag(onset) OVER w, true) AS fresh FROM e WINDOW w AS (PARTITION BY user_id, patch ORDER BY onset, kind, p, d, v)),
k AS (SELECT *, list_concat(CASE WHEN fresh THEN [3 + onset - patch * 1440] ELSE [] END, CASE WHEN kind = 2 THEN [1443 + kind, 1446 + p, 1574 + d, 2599 + v] ELSE [1443 + kind] END) AS x FROM o),
c AS (SELECT *, sum(len(x)) OVER (PARTITION BY user_id, patch ORDER BY i) AS upto FROM k)
SELECT user_id, patch, array_to_string(list_append(flatten(list(x ORDER BY i)), 1), ',') AS tokens FROM c WHERE upto <= 383 GROUP BY user_id, patch"""))
def tokenise_patches(spark, sf_dir):
    found = sequences.tokenise(_notes(spark, sf_dir), ["user_id"], 1440, 384)
    return found.select("user_id", "patch", F.array_join(F.col("tokens").cast("array<string>"), ",").alias("tokens"))
