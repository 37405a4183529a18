"""Quality rules, Bloom filter and URL filter."""

import re

import pytest

from tapeloom.llm import bloom, quality_rules, url_filter
from tapeloom.llm.url_filter import UrlRule

WORDS = re.compile("[^\x20\x09-\x0d]+")


def counted(text):
    t = text or ""
    w = WORDS.findall(t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, g in enumerate(windows) if windows.count(g) > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", "   \n\t\n", "one", "a b", "a b c a b c a b", "x x x x x", "same line\nsame line\n\n \nother\nsame line", "é😀 ß # | <b> & % a\u00a0b\u2003c",
    " ".join(f"word{i}" for i in range(60)), " ".join(f"w{i}%%%" for i in range(60)), "LOUD WORDS HERE " * 30 + " ".join(f"QUIET{i}" for i in range(80)),
    " ".join(f"{i}{'x' * 30}" for i in range(60)), "\n".join(["a line of words"] * 5 + [f"other words {i} {i + 1} {i * 7}" for i in range(30)]), "tiny " + "long word list " * 4000,
]


def test_counts_and_verdicts(spark):
    docs = spark.createDataFrame([(i, t, "mine", i) for i, t in enumerate([*TEXTS, TEXTS[9]])], "doc_id long, text string, kept string, w int").repartition(3)
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, t in enumerate(TEXTS):
        r = got[i]
        if i != len(TEXTS) - 1:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counted(t), t
        n, rep = r.n_words, r.n_repeat_words
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert r.w == i
    assert [got[i].kept for i in (9, 10, 11, 12, 13, 15)] == [True, False, False, False, True, True]
    assert sorted(r.doc_id for r in quality_rules.keep_good(docs).collect()) == sorted(i for i, r in got.items() if r.kept)
    assert quality_rules.keep_good(docs).columns == docs.columns


def test_order_follows_rejections_per_work(spark):
    docs = spark.createDataFrame([(i, "%%% " * 60 if i % 2 else " ".join(f"word{j}" for j in range(60))) for i in range(40)], "doc_id long, text string")
    dear = quality_rules.Rule("dear", lambda t: quality_rules.n_symbols(t) > 5, lambda t: 50 * quality_rules.chars(t))
    none = quality_rules.Rule("none", lambda t: quality_rules.n_words(t) < 0, lambda t: quality_rules.chars(t) * 0 + 1)
    cheap = quality_rules.Rule("cheap", lambda t: quality_rules.n_symbols(t) > 5, lambda t: quality_rules.chars(t))
    assert [x.name for x in quality_rules.order_rules(docs, (dear, none, cheap))][0] == "cheap"


def test_rules_on_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality_rules.judge(empty).count() == 0 and quality_rules.keep_good(empty).count() == 0


@pytest.mark.parametrize("blocks", [1 << 6, 1 << 18])
def test_bloom_loses_no_key(spark, blocks):
    keys = spark.range(0, 40_000, 4).selectExpr("cast(id as string) as k").union(spark.createDataFrame([(None,)], "k string"))
    f = bloom.build(keys, "k", max_blocks=blocks)
    passed = {r.k for r in spark.range(40_000).selectExpr("cast(id as string) as k").where(f.might_contain(_col("k"))).collect()}
    assert {str(i) for i in range(0, 40_000, 4)} <= passed
    if blocks > 1 << 6:
        assert len(passed) < 10_800
    none = bloom.build(keys.limit(0), "k")
    assert keys.where(none.might_contain(_col("k"))).count() == 0


def _col(name):
    from pyspark.sql import functions as F

    return F.col(name)


URLS = [
    (1, "https://WWW.Example.com/en/a?q=1#f", "www.example.com", "/en/a", "www.example.com/en/", "allow"),
    (2, "http://x.example.com/en/", "x.example.com", "/en/", "example.com/en/", "block"),
    (3, "http://example.com", "example.com", "", None, "allow"),
    (4, "http://a.net/es/x", "a.net", "/es/x", "net/es/", "block"),
    (5, "http://net/fr/", "net", "/fr/", "net/fr/", "block"),
    (6, "http://fishnet/fr/", "fishnet", "/fr/", None, "allow"),
    (7, None, "", "", None, "allow"),
    (8, "no scheme", "", "", None, "allow"),
    (9, "", "", "", None, "allow"),
    (10, "https://spam.org/x?utm_source=a&b=2&a=1#z", "spam.org", "/x", None, "block"),
    (11, "http://www.spam.org/x/?a=1&b=2", "www.spam.org", "/x/", None, "block"),
    (12, "http://spam.org/X?a=1&b=2", "spam.org", "/X", None, "allow"),
    (13, "a://b://c/d?e://f", "b:", "//c/d", None, "allow"),
    (14, "http://shop.com?x=/y", "shop.com", "", None, "allow"),
    (15, "http://shop.com/en/", "shop.com", "/en/", "com/", "allow"),
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "theirs", "kept") for i, u, *_ in URLS] * 2, "page_id long, url string, rule string, extra string")
    listing = spark.createDataFrame([("spam.org/x?a=1&b=2",), ("spam.org/x?a=1&b=2",), (None,), ("elsewhere",)], "canonical string")
    got = url_filter.judge(pages, listing)
    rows = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in got.collect())
    assert rows == sorted((i, h, p, r or "", v) for i, _, h, p, r, v in URLS * 2)
    assert set(got.columns) == {"page_id", "url", "extra", "host", "path", "rule", "verdict"}
    assert url_filter.judge(pages.limit(0), listing.limit(0)).count() == 0


def test_longest_rule_wins_and_longer_host_breaks_ties(spark):
    rules = (UrlRule("block", "b.c", "/xy/"), UrlRule("allow", "aa.b.c", "/x"), UrlRule("block", "c", "/"))
    df = spark.createDataFrame([("aa.b.c", "/xy/z"), ("aa.b.c", "/y"), ("d.c", "/"), ("d", "/")], "h string, p string")
    got = df.select(url_filter.decide_by_rules(rules, _col("h"), _col("p")).alias("d")).collect()
    assert [r.d and r.d.rule for r in got] == ["aa.b.c/x", "c/", "c/", None]


def test_columns_of_any_name_pass_through_rules_and_urls(spark):
    docs = spark.createDataFrame([(1, "a b", 7, 8, 9), (2, None, 7, 8, 9)], "doc_id long, text string, _rule_words int, row int, words int")
    got = quality_rules.judge(docs)
    assert got.columns[:5] == docs.columns and [r.words for r in got.collect()] == [9, 9]
    pages = spark.createDataFrame([(1, "http://a.org/x", 7, 8, 9)], "page_id long, url string, _key int, _listed int, canonical int")
    listing = spark.createDataFrame([("a.org/x",)], "canonical string")
    row = url_filter.judge(pages, listing).first()
    assert (row._key, row._listed, row.canonical, row.verdict) == (7, 8, 9, "block")
