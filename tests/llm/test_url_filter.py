import random

from meterlake.llm.queries import URL_RULES
from meterlake.llm.url_filter import Rule, ShiftAnd, filter_urls


def plain(host, path):
    fits = [
        r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    return max(fits, key=lambda r: len(r.label), default=None)


def test_all_rules_at_once():
    rnd = random.Random(1)
    hosts = ["org", "example.org", "a.example.org", "anexample.org", "x.com", "com", "", "co", "e.com:80"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12/x", "/fr/é", "/de/" + "y" * 300, "/x.org/"]
    urls = [(rnd.choice(hosts), rnd.choice(paths)) for _ in range(500)]
    automaton = ShiftAnd(URL_RULES)
    assert automaton.words > 1
    for (host, path), best in zip(urls, automaton.match([(h + p).encode() for h, p in urls]), strict=True):
        wanted = plain(host, path)
        assert (automaton.rules[best] if best >= 0 else None) == wanted, (host, path)


def test_stars():
    automaton = ShiftAnd([Rule("block", "a*.net", "/x*/y"), Rule("block", "b.net", "/x")])
    urls = [b"ads.net/x1/y", b"www.ads.net/x/z/yz", b"ads.net/y", b"a/.net/x1/y", b"b.net/xx"]
    assert [automaton.rules[i].host if i >= 0 else None for i in automaton.match(urls)] == [
        "a*.net", "a*.net", None, None, "b.net",
    ]


def test_pages(spark):
    rows = [
        (1, "HTTP://EN.Example.ORG/es/1?q#f", "x"), (2, None, "x"), (3, "no scheme", "x"), (4, "", "x"),
        (4, "https://shop.com/de/1", "x"), (None, "a://b://c.org/fr/", "x"), (5, "http://x.com?/fr/", "x"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    found = [tuple(r) for r in filter_urls(pages, URL_RULES).collect()]
    assert found == [
        (1, "en.example.org", "/es/1", "example.org/es/", "block"),
        (2, "", "", None, "allow"),
        (3, "", "", None, "allow"),
        (4, "", "", None, "allow"),
        (4, "shop.com", "/de/1", "com/de/", "block"),
        (None, "b:", "//c.org/fr/", None, "allow"),
        (5, "x.com", "", None, "allow"),
    ]
    assert filter_urls(pages.limit(0), URL_RULES).collect() == []
