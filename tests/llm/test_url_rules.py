from __future__ import annotations

from itertools import chain, combinations

from pyspark.sql import functions as F

from barflow.llm import url_rules as U

PAGES = "page_id bigint, url string, html string, host int, path int, tokens int, rule int, base int, key int"
URLS = [
    None, "", "no scheme", "http://", "https://Example.COM", "https://Example.COM/", "https://example.com/en/1",
    "https://www.EXAMPLE.com/en/1", "https://a.www.example.com/en/1?q=1", "https://notexample.com/en/1", "http://x.net/es/9",
    "http://x.net/esp/9", "http://net/fr/2#t", "https://x.org?y=://z.net/es/", "https://a.net#/es/", "ftp://É.com/Ü", "x" * 50_000 + "://a.com/",
    "://b.com/x", "http://c.com\n/en",
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [(len(d + p), d + p, v) for v, d, p in U.BASE_RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else None


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "<p>", 1, 2, 3, 4, 5, 6) for i, u in enumerate(urls)], PAGES)


def test_hosts_paths_and_base_rules(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = U.judge(pages(spark, URLS + URLS), labels).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        host, path, rule = brute(URLS[r.page_id % len(URLS)])
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict) == (rule or (None, "allow"))
    assert U.judge(pages(spark, []), labels).count() == 0


def test_mined_rules_equal_all_combinations(spark):
    urls, labels = [], []
    for i in range(600):
        site, kind, query = ("good", "spam", "mixed")[i % 3], ("ads", "news")[i // 3 % 2], ("", "?ref=x")[i // 6 % 2]
        urls.append(f"http://{site}.org/{kind}/{i}{query}")
        bad = site == "spam" and kind == "ads" or site == "mixed" and query and i % 5 > 0
        if i % 4:
            labels.append((i, int(not bad), 0))
    labels += [(None, 0, 0), (99_999, 0, 0)]
    docs = pages(spark, urls + ["http://spam.org/ads/x", "http://other.org/ads/1"])
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    own = docs.select("page_id", "url", U.host(F.col("url")).alias("host"), U.path(F.col("url")).alias("path"))
    own = own.withColumn("tokens", U.tokens(F.col("url"), F.col("host"), F.col("path")))
    known = [(frozenset(r.tokens), r.bad) for r in U.labelled_pages(own, table).collect()]
    assert len(known) == len(labels) - 1 + 1 - 1
    rules = {frozenset(r.antecedent): (r.confidence, r.key) for r in U.mine(U.labelled_pages(own, table)).collect()}
    share, n = sum(b for _, b in known) / len(known), len(known)
    found = {}
    for ts in {t for t, _ in known}:
        for c in chain.from_iterable(combinations(sorted(ts), k) for k in range(1, len(ts) + 1)):
            if frozenset(c) not in found:
                hits = [b for t, b in known if t.issuperset(c)]
                found[frozenset(c)] = (sum(hits), len(hits))
    strong = {c: p / m for c, (p, m) in found.items() if p >= max(5, 0.002 * n) and p / m >= 0.75 and p / m / share >= 1.5}
    want = {c for c, x in strong.items() if not any(d < c and y >= x - 1e-12 for d, y in strong.items())}
    assert set(rules) == want and want
    for c, (confidence, key) in rules.items():
        assert abs(confidence - strong[c]) < 1e-9 and key in c
    for r in U.judge(docs, table).collect():
        ts = frozenset(next(x for x in own.filter(F.col("page_id") == r.page_id).select("tokens").collect())[0]) if r.page_id > 595 else None
        if ts is not None:
            assert (r.verdict == "block") == any(c <= ts for c in rules)


def test_a_planted_signal_among_many_pages(spark):
    """20,000 pages of which two sites in a certain folder are bad, as in no table here: mined rules decide, and hold on pages without a label."""
    sites = [f"site{k}" for k in range(40)]
    urls = [f"http://{sites[i // 2 % 40]}.example.org/{('en', 'fr', 'bets')[i % 3]}/{i}" for i in range(20_000)]
    bad = [("bets" in u and ("site3." in u or "site8." in u)) or i % 50 == 0 for i, u in enumerate(urls)]
    labels = spark.createDataFrame([(i, int(not b), 0) for i, b in enumerate(bad) if i % 2], "doc_id bigint, quality int, toxic int")
    got = U.judge(pages(spark, urls), labels).filter("page_id % 2 = 0 and page_id % 50 != 0").select("page_id", "verdict", "mined").collect()
    assert all((r.verdict == "block") == bad[r.page_id] == (r.mined is not None) for r in got) and sum(r.verdict == "block" for r in got) > 100
