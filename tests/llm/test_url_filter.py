"""The as-of join of captures and list entries against a plain look at every entry."""

import datetime as dt
import random

from tidemark.llm.url_filter import filter_urls

DAY = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
ENTRIES = [("bad.example", DAY(1), True), ("bad.example", DAY(5), False), ("bad.example", DAY(9), True), ("bad.example", DAY(9), True), ("ok.bad.example", DAY(3), True),
           ("tie.example", DAY(2), True), ("tie.example", DAY(2), False), (None, DAY(1), True), ("late.example", None, True)]
CAPTURES = [(1, "http://bad.example/a", DAY(0)), (2, "https://www.bad.example:8080/", DAY(1)), (3, "https://u:p@x.ok.bad.example/?q=@", DAY(4)), (4, "http://BAD.example./", DAY(5)),
            (5, "http://x.bad.example", DAY(30)), (6, "http://tie.example/", DAY(2)), (7, None, DAY(2)), (8, "not a url", DAY(2)), (9, "http://bad.example/", None), (1, "http://bad.example/a", DAY(0)),
            (None, "http://bad.example/", DAY(2)), (10, "http://late.example/", DAY(3)), (11, "", DAY(1)), (12, "http://localhost/x", DAY(1)), (13, "http://a." + "b" * 50_000 + ".bad.example/", DAY(2))]


def _plain(host, fetched):
    if host is None or fetched is None:
        return None
    best = None
    for domain in {d for d, _, _ in ENTRIES if d}:
        if host == domain or host.endswith("." + domain):
            log = [(at, on) for d, at, on in ENTRIES if d == domain and at is not None and at <= fetched]
            if log and max(log)[1] and len(domain) > len(best or ""):
                best = domain
    return best


def test_every_capture(spark):
    e = spark.createDataFrame(ENTRIES, "domain string, at timestamp_ntz, listed boolean")
    c = spark.createDataFrame([(*r, "h", 1) for r in CAPTURES], "page_id long, url string, fetched timestamp_ntz, host string, salt int")
    got = filter_urls(c, e).collect()
    assert len(got) == len(CAPTURES)
    assert all(r.blocked_by == _plain(r.host, r.fetched) and r.blocked == (r.blocked_by is not None) for r in got)
    assert sorted(r.page_id for r in got if r.blocked and r.page_id) == [2, 3, 5, 6, 13]
    spread = filter_urls(c, e, spread=1).collect()  # several captures of a host and day, each in a part of its own
    assert sorted(spread, key=repr) == sorted(got, key=repr)
    assert not any(r.blocked for r in filter_urls(c, e.limit(0)).collect())
    assert filter_urls(c.limit(0), e).collect() == []


def test_many_dates_and_captures(spark):
    """Random dates within days, on hosts with several listed parents, for one host with most captures."""
    r = random.Random(2)
    names = ["a.b.example", "b.example", "c.b.example", "deep.a.b.example", "other.example"]
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=r.randint(0, 6 * 86_400))
    entries = [(r.choice(names), at(), r.random() < 0.6) for _ in range(120)]
    captures = [(i, f"http://{r.choice(names + ['a.b.example'] * 9)}/", at()) for i in range(600)]
    captures += [(1000 + i, "http://a.b.example/", e[1]) for i, e in enumerate(entries)]
    want = {}
    for i, url, t in captures:
        host, best = url[7:-1], None
        for d in names:
            log = [(a, on) for n, a, on in entries if n == d and a <= t]
            if (host == d or host.endswith("." + d)) and log and max(log)[1] and len(d) > len(best or ""):
                best = d
        want[i] = best
    e = spark.createDataFrame(entries, "domain string, at timestamp_ntz, listed boolean")
    c = spark.createDataFrame(captures, "page_id long, url string, fetched timestamp_ntz")
    for spread in (100_000, 7):
        assert {x.page_id: x.blocked_by for x in filter_urls(c, e, spread=spread).collect()} == want
