"""URL filters against brute force."""

from __future__ import annotations

import datetime as dt

import pytest

from plumbline.llm import url_filter

D = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
ENTRIES = [
    ("ads", "bad.example.com", D(10), True), ("ads", "bad.example.com", D(20), False), ("ads", "bad.example.com", D(30), True), ("spam", "example.com", D(15), True),
    ("spam", "example.com", D(25), False), ("scam", "x.org", D(5), False), ("scam", "x.org", D(5), True), ("ads", None, D(1), True), ("ads", "n.org", None, True), (None, "y.org", D(1), True),
]
CAPTURES = [(u, D(n)) for u in ("http://bad.example.com/p", "https://www.BAD.example.com:8080/x?y#z", "http://sub.bad.example.com", "http://user@example.com/", "http://x.org./", "http://notexample.com/bad.example.com", "http://a.y.org") for n in range(0, 40, 4)]
CAPTURES += [(None, D(1)), ("no url", D(1)), ("http://x.org/", None), ("http://x.org/", D(9)), ("http://x.org/", D(9))]
HOSTS = {"http://bad.example.com/p": "bad.example.com", "https://www.BAD.example.com:8080/x?y#z": "bad.example.com", "http://sub.bad.example.com": "sub.bad.example.com", "http://user@example.com/": "example.com",
         "http://x.org./": "x.org", "http://x.org/": "x.org", "http://notexample.com/bad.example.com": "notexample.com", "http://a.y.org": "a.y.org"}


def brute(url, day):
    host = HOSTS.get(url)
    found = []
    for domain in {e[1] for e in ENTRIES if e[1]}:
        if host and day and (host == domain or host.endswith("." + domain)):
            for category in {e[0] for e in ENTRIES}:
                past = [e for e in ENTRIES if e[0] == category and e[1] == domain and e[2] and e[2] <= day]
                if past and max((e[2], e[3]) for e in past)[1]:
                    found.append((category, domain))
    return host, sorted({c for c, _ in found if c}), max((d for _, d in found), key=len, default=None), bool(found)


@pytest.mark.parametrize("bound", [1 << 26, 0])
def test_equals_brute_force(spark, bound):
    captures = spark.createDataFrame([(*c, "mine", "also") for c in CAPTURES], "url string, day date, domain string, host string")
    entries = spark.createDataFrame(ENTRIES, "category string, domain string, day date, listed boolean")
    out = url_filter.match(captures, entries, broadcast_bytes=bound)
    assert out.columns == ["url", "day", "domain", "host", "categories", "matched_domain", "blocked"]
    got = sorted([(r["url"], r["day"], r["host"], r["categories"], r["matched_domain"], r["blocked"]) for r in out.collect()], key=repr)
    assert got == sorted([(u, d, *brute(u, d)) for u, d in CAPTURES], key=repr)
    assert url_filter.match(captures, entries.limit(0)).where("blocked").count() == 0
    assert url_filter.match(captures.limit(0), entries).count() == 0
