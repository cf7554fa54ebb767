from itertools import combinations

import pytest

from lendwell.llm import url_rules as u


def pages(spark, urls):
    return spark.createDataFrame(
        [(i, url, "x", "clash") for i, url in enumerate(urls)], "page_id long, url string, host string, rule string"
    )


def by_hand(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [r for r in u.GIVEN if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


URLS = [
    "http://WWW.Example.com/en/1", "https://m.example.com/en/5?x=/y", "http://example.com/EN/", "http://example.com", None, "",
    "example.com/en/", "http://a.net/es/1", "http://net/fr/", "http://planet/fr/", "http://x.org/en/#top", "://host.com/p",
    "http://h.com?q=a/b", "ftp://a.b.net/fr/x#y?z", "http://É.com/ü", "http://u://v.com/", "http://xexample.com/en/",
    "http://www.example.com.org/en/", "http:///path", "http://www.example.com/en/?a://b", "http://a\nb.com/",
]


def none_labelled(spark):
    return spark.createDataFrame([], "url string, blocked boolean")


def test_given_rules(spark):
    got = u.judged(pages(spark, URLS * 2), none_labelled(spark)).orderBy("page_id").collect()
    for r, url in zip(got, URLS * 2, strict=True):
        host, path, rule, verdict = by_hand(url)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow"), url


def labelled_urls():
    rows = [(f"http://casino-win.org/en/{i}", True) for i in range(40)]
    rows += [(f"http://news.org/en/{i}?page=2", i % 4 == 0) for i in range(200)]
    rows += [(f"http://shop.org/free/deal/{i}", True) for i in range(30)]
    rows += [(f"http://shop.org/free/item/{i}", False) for i in range(30)]
    return rows + [(None, True), ("http://x.org/", None)]


def rules_by_hand(spark, rows, support, least, confidence):
    """Single tokens, then all combinations of items: tokens of the same urls, without single rules."""
    frame = spark.createDataFrame(rows, "url string, blocked boolean").filter("blocked IS NOT NULL")
    url = u.F.col("url")
    sets = [
        (frozenset(r["t"] or []), r["blocked"])
        for r in frame.select(u.tokens_of(url, u.host_of(url), u.path_of(url)).alias("t"), "blocked").collect()
    ]
    needed = max(support, least / len(sets)) * len(sets)

    def counted(tokens):
        has = [b for t, b in sets if t.issuperset(tokens)]
        return sum(has), len(has)

    out, items = {}, {}
    for token in {x for t, _ in sets for x in t}:
        blocked, urls = counted([token])
        if blocked >= needed and blocked / urls >= confidence:
            out[(token,)] = blocked / urls
        elif blocked >= needed:
            items.setdefault(tuple(token in t for t, _ in sets), []).append(token)
    groups = list(items.values())
    for size in range(1, len(groups) + 1):
        for chosen in combinations(groups, size):
            tokens = tuple(sorted(t for group in chosen for t in group))
            blocked, urls = counted(tokens)
            if blocked >= needed and blocked / urls >= confidence:
                out[tokens] = blocked / urls
    return out


def mined(spark, rows, *settings):
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    found = u.mined_rules(labelled, *settings).collect()
    assert len({tuple(r["rule_tokens"]) for r in found}) == len(found)
    return {tuple(r["rule_tokens"]): r["confidence"] for r in found}


def test_mined_rules_equal_brute_force(spark):
    rows = labelled_urls() + [(f"http://a.org/x/{i}?{'k' if i % 2 else 'l'}=1", i % 2 == 1) for i in range(40)]
    rows += [(f"http://b.org/y/{i}?{'k' if i % 2 else 'l'}=1", i % 2 == 0) for i in range(40)]
    got = mined(spark, rows, 0.001, 10, 0.9)
    assert got == pytest.approx(rules_by_hand(spark, rows, 0.001, 10, 0.9))
    assert ("host:casino",) in got and ("path:deal",) in got and ("path:free",) not in got
    # Neither part tells, both together do.
    assert ("host:a", "path:x", "query:k") in got and ("host:b", "path:y", "query:l") in got and ("query:k",) not in got


def test_mined_rules_of_wide_urls_equal_brute_force(spark):
    common = "http://www.{}.com/" + "/".join(f"d{i}" for i in range(20)) + "/{}?" + "&".join(f"q{i}=1" for i in range(6))
    rows = [(common.format("casino" if i < 15 else "news", f"p{i % 4}"), i < 15 or i % 10 == 0) for i in range(60)]
    rows += [(f"http://www.y.com/{'d1/' if i % 2 else ''}{'d2/' if i % 3 else ''}z?{'q1' if i % 5 else 'q9'}=1", i % 6 in (1, 5)) for i in range(60)]
    got = mined(spark, rows, 0.001, 3, 0.9)
    assert got == pytest.approx(rules_by_hand(spark, rows, 0.001, 3, 0.9))
    assert got[("host:casino",)] == 1.0 and any(len(r) > 3 for r in got) and ("host:www",) not in got


def test_mined_rules_judge_other_urls(spark):
    labelled = spark.createDataFrame(labelled_urls(), "url string, blocked boolean")
    urls = ["http://casino.net/en/1", "http://y.org/deal/free", "http://news.org/en/7?page=2", "http://casino.www.example.com/en/"]
    got = u.judged(pages(spark, urls * 300 + [None]), labelled).collect()
    verdicts = {r["page_id"]: r["verdict"] for r in got}
    assert len(got) == 1201 and verdicts[1200] == "allow"
    assert [verdicts[i] for i in range(4)] == ["block", "block", "allow", "allow"]
    shown = {r["page_id"]: r["mined_rule"] for r in got}
    # A mined rule shows also where a given rule decides.
    assert shown[0] == shown[3] == "host:casino" and shown[2] is None and shown[1200] is None


def test_long_url(spark):
    long = "http://casino.org/" + "/".join(f"p{i}" for i in range(20_000))
    labelled = spark.createDataFrame(labelled_urls(), "url string, blocked boolean")
    assert u.judged(pages(spark, [long]), labelled).first()["verdict"] == "block"


def test_page_labels(spark):
    labels = spark.createDataFrame(
        [(1, 0, 0), (2, 1, 1), (3, 1, 0), (4, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int"
    )
    urls = ["http://a.org/en/1", "http://a.org/en/2.html", "http://a.org/3/?x", "http://a.org/4", "http://x-bets.org/3", None]
    got = {r["url"]: r["blocked"] for r in u.page_labels(pages(spark, urls), labels).collect()}
    assert got == {urls[0]: True, urls[1]: True, urls[2]: False, urls[4]: True}


def test_many_tokens_do_not_explode(spark):
    wide = "http://" + ".".join(f"h{i}" for i in range(30)) + ".org/" + "/".join(f"p{i}" for i in range(60))
    labelled = spark.createDataFrame([(wide, True)] * 50, "url string, blocked boolean")
    assert u.judged(pages(spark, [wide]), labelled).first()["verdict"] == "block"


def test_empty_tables(spark):
    assert u.judged(pages(spark, []), none_labelled(spark)).count() == 0
