import random

from palimpsest.llm import url_filter as u


def brute(url, rules):
    host, path = u.host_and_path(url)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_parts():
    assert u.host_and_path("HTTP://Ex.ORG:80/a?b#c") == ("ex.org:80", "/a")
    assert u.host_and_path("x://a?/b") == ("a", "")
    assert u.host_and_path("a://b://c/d#e") == ("b:", "//c/d")
    assert u.host_and_path("no") == u.host_and_path(None) == u.host_and_path("") == ("", "")


def test_against_brute_force(spark):
    rnd = random.Random(4)
    hosts = ["org", "example.org", "a.example.org", "b.a.example.org", "xample.org", "com", "example.com", "org.com", "c.com", "ex-ample.org"]
    paths = ["/", "/e", "/en/", "/en/1", "/en/12", "", "/é", "/en/1/2"]
    urls = [f"https://{rnd.choice(['', 'www.', 'A.'])}{rnd.choice(hosts)}{rnd.choice(paths)}{rnd.choice(['', '?q=1', '#x', '1'])}" for _ in range(400)]
    urls += [None, "", "://", "http://", "http:///en/", "no url", "http://.org/", "http://org./", "http://example.org"] + ["https://example.org/en/1"] * 200
    rules = list({(rnd.choice(hosts), rnd.choice(paths)): rnd.choice(["allow", "block"]) for _ in range(25)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    for some in (rules, u.RULES, []):
        r = spark.createDataFrame(some + [(None, "/", "block")], "host string, path string, verdict string")
        pages = spark.createDataFrame([(i, x, "h") for i, x in enumerate(urls)], "page_id long, url string, host string").repartition(5)
        got = u.judge(pages, r, ranges=13).collect()
        assert len(got) == len(urls)
        for x in got:
            assert (x.host, x.path, x.rule, x.verdict) == brute(urls[x.page_id], some)


def test_empty_and_null(spark):
    r = spark.createDataFrame(u.RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(None, "http://a.org/x"), (None, "http://a.org/x")], "page_id long, url string")
    assert [x.rule for x in u.judge(pages, r).collect()] == ["org/", "org/"]
    assert u.judge(pages.limit(0), r).count() == 0
