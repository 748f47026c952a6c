import random

from cardflow.llm import url_rules as U


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:cut], rest[cut:]
    cut = min([path.index(c) for c in "?#" if c in path] or [len(path)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path[:cut]


def judge(url, rules, default="allow"):
    host, path = parts(url)
    best = None
    for h, p, a in rules:
        if h and (host == h or host.endswith("." + h)) and path.startswith(p):
            k = (len(h) + len(p), len(h), a, h + p)
            best = max(best or k, k)
    return host, path, best[3] if best else None, best[2] if best else default


def check(spark, urls, rules, ranges):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)],
                               "page_id long, url string, host string, key string")
    got = U.filter_urls(df, U.rules_table(spark, rules), ranges=ranges).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judge(urls[r["page_id"]], rules), urls[r["page_id"]]


def test_against_brute_force(spark):
    rng = random.Random(3)
    labels, seg = ["a", "b", "net", "a1", "a-b", "é"], ["x", "xy", "y", "", "x1"]
    host = lambda n: ".".join(rng.choice(labels) for _ in range(rng.randint(1, n)))
    path = lambda n: "".join("/" + rng.choice(seg) for _ in range(rng.randint(0, n)))
    rules = [(host(3), path(3), rng.choice(["block", "allow"])) for _ in range(60)]
    urls = [f"http://{host(5)}{path(4)}{rng.choice(['', '?q=/x', '#f', '?a://b'])}" for _ in range(600)]
    urls += [f"http://a.net/x?{i}" for i in range(300)]  # one hot url
    check(spark, urls, rules, 7)


def test_odd_urls_and_the_fixed_rules(spark):
    urls = [None, "", "no scheme", "://", "http://", "http://NET/", "http://net", "https://x.example.net/en/a",
            "http://example.net/EN/", "http://notexample.net/en/", "http://example.com/de/", "http://a.org/fr/x#y",
            "http://org/fr", "http://a..net/", "http://.net/", "http://a\x01b.net/", "http://u@h.net:80/",
            "http://" + "a." * 500 + "net/" + "p" * 50_000, "http://example.net/en/", "http://example.net/en/"]
    check(spark, urls, U.RULES, 3)


def test_empty_tables_and_rules(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert U.filter_urls(none, U.rules_table(spark)).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, action string")
    assert U.filter_urls(one, rules).first()["verdict"] == "allow"
    odd = spark.createDataFrame([(None, "/", "block"), ("", "/", "block"), ("net", None, "block"), ("NET", "/", "block")],
                                "host string, path string, action string")
    assert U.filter_urls(one, odd).first()["rule"] == "net/"
