from __future__ import annotations

import math
import re

import pytest

from hazgrid.llm import urls

URLS = [
    "http://example.com/en/1", "https://www.example.com/en/1?x", "https://WWW.Example.com/fr/", "http://a.b.example.com/en/", "http://x.net/es/1", "http://x.net/fr", "http://x.net/fr/", "http://com/", "http://com", "no scheme", "", None, "a://b://c/d", "http://notexample.com/en/",
    "http://user@h.org:80/p#f", "http://x.co.uk/a", "http://bad.org/1", "http://bad.org/2", "http://bad.org/3", "http://m.bad.org/4", "http://É.org/é?q", "://", "x:///p", "http://a\nb.org/\nc",
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for h, p, v in urls.UrlRules().rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return host, path, *(best or (None, None))


def test_rules_and_parts(spark):
    rows = list(enumerate([*URLS, URLS[0]]))
    pages = spark.createDataFrame([(i, u, "clash") for i, u in rows], "page_id long, url string, host string")
    labels = spark.createDataFrame([(16, 1), (17, 1), (18, 1), (19, 1), (16, 0), (None, 1), (0, None)], "page_id long, bad long")
    got = {x["page_id"]: x for x in urls.judge_urls(pages, labels).collect()}
    assert len(got) == len(rows)
    for i, u in rows:
        host, path, rule, verdict = brute(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert verdict is None or got[i]["verdict"] == verdict
    assert got[16]["n_labelled"] == 3 and got[16]["n_bad"] == 3
    none = urls.judge_urls(pages, labels.limit(0)).collect()
    assert len(none) == len(rows) and all(x["verdict"] == "allow" for x in none if brute(x_url := dict(rows)[x["page_id"]])[3] is None or x_url is None)
    assert urls.judge_urls(pages.limit(0), labels).count() == 0


def test_outcomes_are_those_of_the_documents_shown(spark):
    pages = spark.createDataFrame(list(enumerate(["http://a.b/en/12", "http://a.b/12.html?x=7", "http://a.b/x/12/", "http://a.b/12x", "http://a.b/" + "9" * 30, "http://a.b", None, "http://a.b/en/13#top", "http://a.b/14", "http://a.b/15"])), "page_id long, url string")
    labels = spark.createDataFrame([(12, 1, 1), (13, 1, 0), (13, 0, 0), (None, 0, 0), (14, None, 1), (15, None, None)], "doc_id long, quality int, toxic int")
    got = {x["page_id"]: x["bad"] for x in urls.outcomes_of(pages, labels).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 7: 1, 8: 1}


def strength(counts):
    counts = [(n, b) for n, b in counts if n]
    g, t = len(counts), sum(n for n, _ in counts)
    p = sum(b for _, b in counts) / t
    m = sum(n * (b / n - p) ** 2 for n, b in counts)
    below = p * (1 - p) * (t - sum(n * n for n, _ in counts) / t - (g - 1))
    rho = (m - p * (1 - p) * (g - 1)) / below if below else None
    return 10.0 if rho is None else 1000.0 if rho <= 0 else min(max(1 / rho - 1, 2.0), 1000.0)


def test_posteriors_equal_brute_force(spark):
    hosts = {"a.x.org": (9, 8), "b.x.org": (4, 0), "x.org": (0, 0), "c.y.org": (30, 1), "d.z.net": (12, 5), "e.z.net": (1, 1), "f.w.net": (6, 6)}
    pages, labels, k = [], [], 0
    for h, (n, b) in hosts.items():
        for i in range(max(1, n)):
            pages.append((k, f"http://{h}/"))
            labels += [(k, int(i < b))] * (n > 0)
            k += 1
    got = {x["host"]: x for x in urls.reputations(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad long")).collect()}
    domain, suffix = {h: ".".join(h.split(".")[-2:]) for h in hosts}, {h: h.split(".")[-1] for h in hosts}
    pool = lambda key: {v: tuple(map(sum, zip(*(hosts[h] for h in hosts if key[h] == v), strict=True))) for v in key.values()}
    d, s = pool(domain), pool(suffix)
    top = sum(b for _, b in hosts.values()) / sum(n for n, _ in hosts.values())
    ms, md, mh = (strength(x.values()) for x in (s, d, hosts))
    for h, (n, b) in hosts.items():
        mean_s = (s[suffix[h]][1] + ms * top) / (s[suffix[h]][0] + ms)
        mean_d = (d[domain[h]][1] + md * mean_s) / (d[domain[h]][0] + md)
        mean = (b + mh * mean_d) / (n + mh)
        assert got[h]["mean"] == pytest.approx(mean) and got[h]["lower"] == pytest.approx(mean - 1.645 * math.sqrt(mean * (1 - mean) / (n + mh + 1)))


def test_bad_hosts_are_blocked_and_others_are_not(spark):
    sites = {"spam.org": (40, 38), "www.spam.org": (0, 0), "fine.org": (60, 1), "fresh.org": (0, 0), "one.bad.co.uk": (25, 25), "two.bad.co.uk": (0, 0), "good.co.uk": (30, 0), "few.org": (2, 2)}
    pages, labels = [], []
    for h, (n, b) in sites.items():
        for i in range(max(1, n)):
            pages.append((len(pages), f"http://{h}/{i}"))
            labels += [(len(pages) - 1, int(i < b))] * (n > 0)
    got = {x["host"]: x["verdict"] for x in urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad long")).collect()}
    assert {h for h, v in got.items() if v == "block"} == {"spam.org", "one.bad.co.uk"} | {h for h in ("few.org", "two.bad.co.uk", "www.spam.org") if got[h] == "block"} and got["fine.org"] == got["fresh.org"] == got["good.co.uk"] == "allow"


def test_registered_domains(spark):
    names = {"a.b.org": ("b.org", "org"), "a.b.co.uk": ("b.co.uk", "co.uk"), "u:p@a.b.org:8080": ("b.org", "org"), "co.uk": ("co.uk", "co.uk"), "10.1.2.3:80": ("10.1.2.3", "10.1.2.3"), "x.github.io": ("x.github.io", "github.io"), "": ("", ""), "a.co.info": ("co.info", "info")}
    rules = urls.UrlRules(suffixes=("github.io",))
    name = urls.name_of(urls.F.col("host"))
    rows = spark.createDataFrame([(h,) for h in names], "host string").select("host", urls.suffix_of(name, rules).alias("suffix")).select("host", "suffix", urls.domain_of(name, urls.F.col("suffix")).alias("domain")).collect()
    assert {x["host"]: (x["domain"], x["suffix"]) for x in rows} == names
