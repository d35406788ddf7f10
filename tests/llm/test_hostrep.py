import pytest

from arcwright.llm import hostrep as H

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block")]
URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1", "http://example.com/en/", "http://a.example.com/en/x?y=/z#w", "http://notexample.com/en/", "http://x.net/es/1",
    "http://net/es/1", "http://x.net/ES/1", "http://x.net?/es/", "http://x.net#/es/", "http://x.net/es", "a://b://c.net/es/", "http://com", "http://com/", "http://u@x.com:80/", "http://É.org/ü\nv", "http://x.org/" + "y" * 5000, "http://..net/es/",
]


def host_and_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]


def rule_of(host, path):
    fits = [(len(r), r, v) for r, v in RULES if (host == (h := r.split("/", 1)[0]) or host.endswith("." + h)) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits)[1:] if fits else None


def rates(pages, bad):
    """Means and lower bounds by host, level by level."""
    hosts = {}
    for page, url in pages:
        n, k = hosts.get(host_and_path(url)[0], (0, 0))
        y = bad.get(page)
        hosts[host_and_path(url)[0]] = (n + (y is not None), k + (y or 0))

    def suffix(h):
        two = ".".join(h.split(".")[-2:])
        return two if two in H.SUFFIXES else h.split(".")[-1]

    def domain(h):
        return ".".join(h.split(".")[-2 - (".".join(h.split(".")[-2:]) in H.SUFFIXES) :])

    def summed(by):
        out = {}
        for h, (n, k) in hosts.items():
            a, b = out.get(by(h), (0, 0))
            out[by(h)] = (a + n, b + k)
        return out

    def shrunk(counts, up):
        spread = {c: up(c) * (1 - up(c)) for c in counts}
        over = sum((k - n * up(c)) ** 2 - n * spread[c] for c, (n, k) in counts.items())
        under = sum(n * (n - 1) * spread[c] for c, (n, k) in counts.items())
        rho = min(H.MOST_RHO, max(H.LEAST_RHO, over / under if under else H.LEAST_RHO))
        w = 1 / rho - 1
        return {c: (w * up(c) + k) / (w + n) for c, (n, k) in counts.items()}, w

    total = (sum(k for _, k in hosts.values()) + 1) / (sum(n for n, _ in hosts.values()) + 2)
    of_suffix, _ = shrunk(summed(suffix), lambda s: total)
    of_domain, _ = shrunk(summed(domain), lambda d: of_suffix[suffix(d)])
    of_host, w = shrunk(hosts, lambda h: of_domain[domain(h)])
    out = {}
    for h, (n, k) in hosts.items():
        m = of_host[h]
        good = w * (1 - of_domain[domain(h)]) + n - k
        out[h] = (m, m - H.SIGMAS * (m * good / (w + n) / (w + n + 1)) ** 0.5)
    return out


def table(spark, urls):
    return spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")


def test_hosts_paths_and_rules(spark):
    none = spark.createDataFrame([], "page_id long, bad boolean")
    found = {r.page_id: r for r in H.judged(table(spark, URLS), none, H.rules_table(spark, RULES)).collect()}
    assert len(found) == len(URLS)
    for i, url in enumerate(URLS):
        host, path = host_and_path(url)
        rule = rule_of(host, path)
        assert (found[i].host, found[i].path) == (host, path), url
        assert (found[i].rule, found[i].verdict) == (rule or (None, "allow")), url
        assert found[i].bad_rate == 0.5


def test_rates_against_a_plain_computation(spark):
    hosts = ["a.x.org", "b.x.org", "c.y.org", "y.org", "z.co.uk", "w.z.co.uk", "bad.net", "good.net", "", "one"]
    pages = [(i, f"http://{hosts[i % len(hosts)]}/p") for i in range(400)] + [(None, "http://bad.net/q"), (3, "http://new.org/")]
    bad = {i: hosts[i % len(hosts)] == "bad.net" and i % 7 > 0 or i % 11 == 0 for i in range(0, 400) if i % 3}
    labels = spark.createDataFrame([(i, b) for i, b in bad.items()] + [(1, None), (None, True)], "page_id long, bad boolean")
    df = spark.createDataFrame(pages, "page_id long, url string")
    expected = rates(pages, bad)
    rows = H.judged(df, labels, H.rules_table(spark, RULES)).collect()
    assert len(rows) == len(pages)
    for r in rows:
        mean, low = expected[r.host]
        assert (r.bad_rate, r.bad_low) == pytest.approx((mean, low), abs=2e-9)
        assert r.verdict == ("block" if low > 0.5 else "allow")
    assert {r.host for r in rows if r.verdict == "block"} == {"bad.net"}
    kept = H.allowed(df, labels, H.rules_table(spark, RULES))
    assert kept.columns == df.columns
    assert kept.where("url like '%bad.net%'").collect() == [(None, "http://bad.net/q")]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, bad boolean")
    assert H.judged(table(spark, []), none, H.rules_table(spark, RULES)).count() == 0
    no_rules = spark.createDataFrame([], "host string, path string, rule string, verdict string")
    assert [r.verdict for r in H.judged(table(spark, ["http://x.com/"]), none, no_rules).collect()] == ["allow"]
    odd = spark.createDataFrame([(None, "/", "n", "block"), ("", "/", "e", "block"), ("x.com", None, "p", "block")], "host string, path string, rule string, verdict string")
    assert [r.verdict for r in H.judged(table(spark, ["http://x.com/", "no"]), none, odd).collect()] == ["allow"] * 2


def test_labels_as_outcomes(spark):
    rows = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, None, None), (5, None, 0), (6, 0, None)], "doc_id long, quality int, toxic int")
    assert {r.page_id: r.bad for r in H.labelled(rows).collect()} == {1: False, 2: True, 3: True, 4: None, 5: False, 6: True}
