import random

from bondweave.llm import urls


def plain(url, rules):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for verdict, h, p in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(h + p), len(h))
            if best is None or key > best[0]:
                best = (key, h + p, verdict)
    return host, path, best and best[1], best[2] if best else "allow"


def test_against_all_rules(spark):
    rnd = random.Random(5)
    labels = ["com", "net", "example", "www", "a", "ab", "a-b", "é", ""]
    host = lambda: ".".join(rnd.choice(labels) for _ in range(rnd.randint(1, 4)))
    path = lambda: "".join(rnd.choice(["/", "/en/", "/es/", "x", "en"]) for _ in range(rnd.randint(0, 3)))
    rules = [*urls.RULES, *{(h, p): (rnd.choice(["allow", "block"]), h, p) for h, p in ((host(), path()) for _ in range(60)) if h and p}.values()]
    rules = list({(h, p): (v, h, p) for v, h, p in rules}.values())
    pages = [(i, rnd.choice(["http", "HTTPS"]) + "://" + rnd.choice([host(), host().upper(), "www.example.com"]) + path() + rnd.choice(["", "?q=/x", "#f", "?a://b"])) for i in range(1500)]
    pages += [(9000, None), (9001, ""), (9002, "no scheme/en/"), (9003, "://"), (9004, "http://"), (3, pages[3][1]), (None, "http://x.com/en/"), (9005, "http://example.com/" + "y" * 100_000)]
    df = spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "'clash' AS host", "0 AS rule")
    got = urls.judge(df, urls.rules_frame(spark, tuple(rules)), ranges=7).collect()
    want = sorted(str((i, *plain(u, rules))) for i, u in pages)
    assert sorted(str(tuple(r)) for r in got) == want


def test_empty_and_no_rules(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(none, urls.rules_frame(spark)).collect() == []
    one = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    rules = spark.createDataFrame([], "verdict string, host string, path string")
    assert [tuple(r) for r in urls.judge(one, rules).collect()] == [(1, "a.com", "/", None, "allow")]


def test_hot_host_is_split(spark):
    df = spark.range(5000).selectExpr("id AS page_id", "concat('http://hot.net/es/', id) AS url")
    got = urls.judge(df, urls.rules_frame(spark), ranges=10)
    sizes = [r["count"] for r in got.groupBy("verdict").count().collect()]
    assert sizes == [5000]


def test_many_rules_of_one_host(spark):
    rules = tuple(("block", "big.org", f"/p{i}/") for i in range(3000)) + (("allow", "big.org", "/p7/ok/"), ("allow", "org", "/p8/ok/much/longer/"))
    pages = [(i, f"http://x.big.org/p{i}/a") for i in range(0, 6000, 50)] + [(10_000, "http://big.org/p7/ok/a"), (10_001, "http://big.org/p8/ok/much/longer/a")]
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), urls.rules_frame(spark, rules), ranges=3).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str((i, *plain(u, rules))) for i, u in pages)
