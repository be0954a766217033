import fnmatch
import random

from mailgrid.llm import url_filter
from mailgrid.llm.queries import RULES, UNWANTED


def test_globs_equal_fnmatch():
    random.seed(5)
    for _ in range(60):
        globs = ["".join(random.choices("ab*?/", k=random.randint(0, 9))) for _ in range(30)]
        texts = ["".join(random.choices("ab/", k=random.randint(0, 12))) for _ in range(40)]
        hits = url_filter.Globs([g.encode() for g in globs]).match([t.encode() for t in texts])
        for t, row in zip(texts, hits):
            assert list(row) == [fnmatch.fnmatchcase(t, g) for g in globs], t


def plain(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        for stop in "?#":
            rest = rest.split(stop)[0]
        cut = rest.find("/")
        host, path = (rest, "") if cut < 0 else (rest[:cut], rest[cut:])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [
        (h + p, v) for v, h, p in RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    if fit:
        rule, verdict = max(fit, key=lambda f: len(f[0]))
        return host, path, rule, verdict
    spam = any(fnmatch.fnmatchcase(host, g) for g in UNWANTED)
    return host, path, None, "block" if spam else "allow"


def test_urls(spark):
    urls = [
        None, "", "no scheme", "http://", "http://net", "http://NET/x", "http://a.net/en/x",
        "https://example.net/en/", "https://www.Example.net/en/a?b=/de/", "http://xexample.net/en/",
        "http://example.com/de/", "http://example.com/de", "http://a.org/fr/1#x", "http://org/fr/",
        "http://a.org/fr?x", "http://adult-x.example.com/en/", "http://x.org/a.net/", "a://b://c.net/",
        "http://é.net/ä\xff", "http://h/" + "x" * 5000, "http://h.net/" + "x" * 5000,
    ]
    rows = list(enumerate(urls)) + [(None, "http://a.net/"), (3, "http://net/x"), (3, "http://net/x")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = url_filter.judge_urls(pages, RULES, UNWANTED).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *plain(u))) for i, u in rows)
    empty = pages.filter("false")
    assert url_filter.judge_urls(empty, RULES, UNWANTED).count() == 0
