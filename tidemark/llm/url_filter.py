"""URL filtering by a temporal list join, in DataFrame operations only.

A list is a log of dated entries (domain, at, listed). For every host seen in the
captures, the state of the host and of its parent domains is read at each date
that any of them is dated, by an as-of join; the most specific listed one is the
host's state from that date on, until the next: a validity interval, of which the
host has one for each date. Every capture is then joined as of its fetch time: a
union with the host's dates and one window, so neither intervals nor captures
ever multiply.

That window goes by host and day, each day beginning with the state that holds
there, so a host's captures are worked on by days. A host and day with more than
``SPREAD`` captures are spread over as many parts as that takes, and its dates of
that day are repeated for the parts that have captures.

Defined cases: a URL that is null or has no host is never blocked (host null);
hosts compare in lower case without port, user and last dot; entries of a domain
equal in time: listed wins; an entry at the fetch time itself counts; null fetch
times match nothing; repeated list rows count once; repeated captures each get
an answer; an empty list blocks nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
#: Captures of a host and day that one part of the window takes.
SPREAD = 100_000


def host_of(url):
    """The host of a URL in lower case, or null."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", "")
    return F.when(host != "", host)


def domains_of(host):
    """The host and its parent domains of two labels or more."""
    labels = F.split(host, r"\.")
    depth = F.greatest(F.size(labels) - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), depth), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _as_of(probes: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    """probes with `held`, the struct of the last state of its keys at or before its `at`. states: keys, at, held."""
    none = F.lit(None).cast(states.schema["held"].dataType)
    both = probes.withColumn("held", none).withColumn("asks", F.lit(True)).unionByName(states.select(*keys, "at", "held").withColumn("asks", F.lit(False)), allowMissingColumns=True)
    own = Window.partitionBy(*keys).orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("held", F.last("held", ignorenulls=True).over(own)).where("asks").drop("asks")


def overlay(hosts: DataFrame, entries: DataFrame) -> DataFrame:
    """(host, at, domain): from each date on, the most specific listed one of the host's domains; null where none is."""
    log = entries.where("at is not null").groupBy("domain", "at").agg(F.max("listed").alias("listed"))
    names = hosts.select("host", F.explode(domains_of(F.col("host"))).alias("domain"))
    states = names.join(log, "domain").select("host", "domain", "at", F.struct("listed").alias("held"))
    dates = states.select("host", "at").distinct()
    # a date asks for each of the host's names, of which there are as many as it has labels
    state = _as_of(dates.join(names, "host"), states, ["host", "domain"])
    listed = F.when(F.col("held.listed"), F.length("domain"))
    return state.groupBy("host", "at").agg(F.max_by(F.when(F.col("held.listed"), F.col("domain")), listed).alias("domain"))


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched", spread: int = SPREAD) -> DataFrame:
    """One row per capture: id, host, fetched, blocked_by (null if allowed), blocked."""
    seen = cut(captures.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), F.col(time_col).alias("fetched")).withColumn("row", F.monotonically_increasing_id()))
    dated = seen.where("host is not null and fetched is not null").withColumn("day", F.to_date("fetched"))
    days = cut(dated.groupBy("host", "day").agg(F.count("*").alias("n")))
    parts = max(1, -(-(days.agg(F.max("n")).first()[0] or 0) // spread))
    dated = dated.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    points = cut(overlay(days.select("host").distinct(), entries.select("domain", "at", "listed")))
    kind = dict(seen.dtypes)["fetched"]
    points = points.select("host", F.col("at").cast(kind).alias("at"), F.struct("domain").alias("held"))
    begins = _as_of(days.select("host", "day", F.col("day").cast(kind).alias("at")), points, ["host"]).where("held is not null")
    inside = points.withColumn("day", F.to_date("at")).join(days.select("host", "day"), ["host", "day"], "left_semi")
    states = begins.select("host", "day", "at", "held").unionByName(inside.select("host", "day", "at", "held"))
    if parts > 1:
        states = states.join(dated.select("host", "day", "part").distinct(), ["host", "day"])
    else:
        states = states.withColumn("part", F.lit(0))
    found = _as_of(dated.withColumnRenamed("fetched", "at"), states, ["host", "day", "part"]).select("id", "host", F.col("at").alias("fetched"), F.col("held.domain").alias("by"))
    rest = seen.where("host is null or fetched is null").select("id", "host", "fetched", F.lit(None).cast("string").alias("by"))
    return found.unionByName(rest).select(F.col("id").alias(id_col), "host", "fetched", F.col("by").alias("blocked_by"), F.col("by").isNotNull().alias("blocked"))
