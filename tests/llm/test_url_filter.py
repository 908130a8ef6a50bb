import random

from hazardframe.llm import url_filter
from hazardframe.llm.queries import URL_RULES

URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x", "http://example.com/en/1", "http://example.com/fr/", "http://a.b.example.com/en/",
        "http://net/es/?q", "https://x.net/fr/a#b", "https://x.net/fr", "http://com", "http://com/", "http://xcom/", "http://a.org/://b.com/", "http://a?b/c", "ftp://É.net/es/é/ü",
        "http://a.com:80/", "http://u@b.com/en", "http://" + "a." * 500 + "com/" + "p/" * 2000]


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = path = ""
    for i, c in enumerate(rest + "?"):
        if c in "/?#":
            host = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in rest[:i])
            path = rest[i:]
            break
    for c in "?#":
        path = path.split(c)[0]
    fit = [(len(h + p), h.count("."), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else default


def check(spark, urls, rules, **options):
    pages = spark.createDataFrame([(i, u, "old", 1) for i, u in enumerate(urls)], "page_id long, url string, rule string, block long")
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = url_filter.url_filter(pages, listed, **options).orderBy("page_id").collect()
    assert len(got) == len(urls)
    for r, u in zip(got, urls):
        assert tuple(r.url_rule) == brute(u, rules), u
        assert r.rule == "old" and r.block == 1


def test_rules_of_the_contract(spark):
    check(spark, URLS + URLS[4:8], URL_RULES)


def test_long_list_both_joins(spark):
    """More keys than the filter tells apart, so the exact join has false positives to remove."""
    rnd = random.Random(5)
    name = lambda: ".".join(rnd.choice(["a", "b", "c", "news", "shop"]) for _ in range(rnd.randint(1, 3)))
    rules = sorted({(name(), "/" + "".join(rnd.choice("xy/") for _ in range(rnd.randint(0, 4)))) for _ in range(300)})
    rules = [(h, p, rnd.choice(["allow", "block"])) for h, p in rules]
    urls = [f"http://{name()}/" + "".join(rnd.choice("xyz/") for _ in range(rnd.randint(0, 8))) for _ in range(400)]
    check(spark, urls, rules)
    check(spark, urls, rules, broadcast_rows=0)


def test_empty_tables_and_contradictions(spark):
    check(spark, URLS, [])
    check(spark, [], URL_RULES)
    listed = spark.createDataFrame([("a.com", "/", "allow"), ("a.com", "/", "block"), ("A.com", "/", "allow")], "host string, path string, verdict string")
    pages = spark.createDataFrame([("http://a.com/",)], "url string")
    assert url_filter.url_filter(pages, listed).first().url_rule.verdict == "block"


def test_hot_url_is_judged_once_and_kept_whole(spark):
    check(spark, ["http://www.example.com/en/"] * 500 + ["http://b.net/es/"], URL_RULES)


def test_bloom_has_no_false_negatives_and_a_bounded_size(spark):
    keys = spark.range(5000).selectExpr("concat('k', id) AS k")
    bloom = url_filter.blocked_bloom(keys, "k", 5000)
    assert bloom.count() <= url_filter._n_blocks(5000) <= url_filter.MAX_BLOCKS
    probe = lambda p: (spark.range(5000).selectExpr(f"concat('{p}', id) AS k").select(*url_filter._place(__import__("pyspark").sql.functions.col("k"), url_filter._n_blocks(5000)))
                       .join(bloom, "block").filter(" AND ".join(f"(w{j} & b{j}) != 0" for j in range(4))).count())
    assert probe("k") == 5000 and probe("other") < 500
    assert url_filter._n_blocks(10**12) == url_filter.MAX_BLOCKS
