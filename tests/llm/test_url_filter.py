from __future__ import annotations

import random
from collections import defaultdict

import pytest

from shelfline.llm import url_filter as urls
from tests.llm.cases import UPPER, tuples

ODD = [None, "", "no scheme/en/", "http://", "https://EXAMPLE.com", "http://a.example.com/en/x?y#z",
       "http://www.example.com/en/x", "http://badexample.com/en/x", "http://x.net/es/1", "x://h?q/en/",
       "http://net/fr/", "http://n.net/FR/", "a://b://c.com/en/", "http://u.com/en/\nq", "http://example.com/en"]


def plain(url):
    """(host, path, rule, verdict of the rules)."""
    host = path = ""
    if url and "://" in url:
        after = url.split("://", 1)[1]
        cut = min([after.find(c) for c in "/?#" if c in after], default=len(after))
        host = after[:cut].translate(str.maketrans(UPPER, UPPER.lower()))
        rest = after[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


def pages(spark, found):
    df = spark.createDataFrame(found, "page_id bigint, url string")
    return df.selectExpr("*", "'x' AS host", "1 AS path", "2 AS verdict", "'h' AS html", "3 AS bad")


NO_LABELS = "page_id bigint, bad int"


def test_split_and_rules(spark):
    rows = list(enumerate(ODD)) + [(None, ODD[5]), (5, ODD[5]), (5, ODD[5])]
    got = urls.filter_urls(pages(spark, rows), spark.createDataFrame([], NO_LABELS))
    expected = [(i, *plain(u)) for i, u in rows]
    expected = [(*e[:4], e[4] or "allow") for e in expected]
    key = lambda r: tuple(map(str, r))
    found = tuples(got, "page_id", "host", "path", "rule", "verdict")
    assert sorted(found, key=key) == sorted(expected, key=key)


def site():
    rows = [(n, f"http://a.org/spam/{n}/x{n}.html") for n in range(60)]
    rows += [(n, f"http://a.org/news/{n}") for n in range(100, 160)]
    rows += [(n, f"http://a.org/{kind}/slug-{'abcdefgh'[n % 8]}{'xyz'[n % 3]}{n}") for n, kind in
             zip(range(200, 260), ["blog", "wiki"] * 30)]
    labels = [(n, 1) for n in range(0, 60, 2)] + [(n, 0) for n in range(100, 160, 2)]
    labels += [(n, 0) for n in range(200, 260, 3)] + [(None, 1), (101, None)]
    return rows, labels


def test_templates_are_judged_by_purity(spark):
    rows, labels = site()
    known = spark.createDataFrame(labels, NO_LABELS)
    got = {r.page_id: r for r in urls.filter_urls(pages(spark, rows), known, rules=[]).collect()}
    assert {got[n].verdict for n in range(60)} == {"block"}
    assert {got[n].verdict for n in [*range(100, 160), *range(200, 260)]} == {"allow"}
    assert {got[n].template for n in range(60)} == {"/spam/#/x#.html"}
    # Branches of one form with like rates are one group with one purity.
    assert len({got[n].purity for n in range(200, 260)}) == 1


def test_rare_children_become_wildcards(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(n, f"http://a.org/u/{letters[n % 26]}{letters[n // 26]}q/home") for n in range(200)]
    got = urls.filter_urls(pages(spark, rows), spark.createDataFrame([], NO_LABELS), rules=[])
    assert {r.template for r in got.collect()} == {"/u/*/home"}


def test_many_equal_sections_are_judged_by_their_own_labels(spark):
    """Each of 25 sections is below a twentieth of its host; one is bad, or all but one."""
    kinds = "abcdefghijklmnopqrstuvwxy"
    rows = [(n, f"http://a.org/s{kinds[n % 25]}/p{n}") for n in range(1500)]
    rows += [(n + 2000, u.replace("a.org", "b.org")) for n, u in rows]
    labels = [(n, int(n % 25 == 3)) for n in range(0, 1500, 2)]
    labels += [(n + 2000, int(n % 25 != 3)) for n in range(0, 1500, 2)]
    known = spark.createDataFrame(labels, NO_LABELS)
    got = {r.page_id: r.verdict for r in urls.filter_urls(pages(spark, rows), known, rules=[]).collect()}
    assert {n for n in range(1500) if got[n] == "block"} == set(range(3, 1500, 25))
    assert {n for n in range(1500) if got[n + 2000] == "allow"} == set(range(3, 1500, 25))


def test_deep_branches_are_judged_by_themselves(spark):
    deep = "/".join("abcdefgh")
    rows = [(n, f"http://a.org/{deep}/{'casino' if n % 2 else 'recipes'}/{n}") for n in range(80)]
    rows += [(90, "http://a.org/" + deep), (91, "http://b.org/x/y1/z/q/r/s")]
    known = spark.createDataFrame([(n, n % 2) for n in range(60)], NO_LABELS)
    got = {r.page_id: r for r in urls.filter_urls(pages(spark, rows), known, rules=[]).collect()}
    assert {n for n in range(80) if got[n].verdict == "block"} == set(range(1, 80, 2))
    assert got[1].template == f"/{deep}/casino/#" and got[91].template == "/*/*/*/*/*/*"


def plain_tree(shapes, share, least, least_labels):
    """Templates of (host, shape, pages, labelled) rows, level by level."""
    out = {}

    def grow(rows, at, template):
        for host, shape, *_ in (r for r in rows if len(r[1]) == at):
            out[host, shape] = template
        rows = [r for r in rows if len(r[1]) > at]
        total = sum(r[2] for r in rows)
        if total < least or len(rows) == 1:
            for host, shape, *_ in rows:
                left = shape[at:] if total >= least else tuple(s if s == "#" else "*" for s in shape[at:])
                out[host, shape] = template + left
            return
        children = defaultdict(list)
        for r in rows:
            children[r[1][at]].append(r)
        groups = defaultdict(list)
        for part, own in children.items():
            pages, labelled = sum(r[2] for r in own), sum(r[3] for r in own)
            stays = part == "#" or pages >= least and (pages >= share * total or labelled >= least_labels)
            groups[part if stays else "*"] += own
        for part, own in groups.items():
            grow(own, at + 1, (*template, part))

    for host in {r[0] for r in shapes}:
        grow([r for r in shapes if r[0] == host], 0, ())
    return out


def tree_cases():
    pick = random.Random(11)
    shapes = {}
    for host in "abcd":
        for _ in range(120):
            shape = tuple(pick.choice("xxxyz#") for _ in range(pick.randrange(0, 9)))
            if host == "b":
                shape = ("p", "q", "r", *shape)
            if host == "c":  # a chain with an end at every level
                shape = ("k",) * pick.randrange(1, 30)
            shapes[host, shape] = (pick.randrange(1, 6), pick.randrange(0, 4))
    return [(host, shape, pages, labelled) for (host, shape), (pages, labelled) in shapes.items()]


@pytest.mark.parametrize("share,least,labels", [(0.05, 5, 5), (0.3, 12, 8), (0.2, 1, 1)])
def test_tree_equals_the_one_grown_level_by_level(spark, share, least, labels):
    rows = tree_cases()
    df = spark.createDataFrame(rows, "host string, shape array<string>, pages bigint, labelled bigint")
    got = urls.template_tree(df, share, least, labels).collect()
    assert len(got) == len(rows)
    assert {(r.host, tuple(r.shape)): tuple(r.template) for r in got} == plain_tree(rows, share, least, labels)


def test_rounds_do_not_follow_the_depth(spark, monkeypatch):
    """300 levels, in one long path that branches at its end and as a trap with every depth."""
    deep = "/".join(["d"] * 300)
    rows = [(n, f"http://a.org/{deep}/{'bad' if n % 2 else 'good'}/{n}") for n in range(60)]
    rows += [(100 + n, "http://b.org" + "/loop" * n) for n in range(1, 300)]
    known = spark.createDataFrame([(n, n % 2) for n in range(60)], NO_LABELS)
    stored = []
    real = urls.hand_over
    monkeypatch.setattr(urls, "hand_over", lambda df, stem: stored.append(stem) or real(df, stem))
    got = {r.page_id: r for r in urls.filter_urls(pages(spark, rows), known, rules=[]).collect()}
    assert stored.count("url-nodes") <= 4
    assert {n for n in range(60) if got[n].verdict == "block"} == set(range(1, 60, 2))
    assert got[399 - 100].template == "/loop" * 199 and got[399].template == "/loop" * 295 + "/*" * 4


def test_empty_labels_and_page_labels(spark):
    none = pages(spark, [])
    assert urls.filter_urls(none, spark.createDataFrame([], NO_LABELS)).count() == 0
    found = pages(spark, [(1, "http://a/en/12.html"), (2, "http://a/en/12/"), (3, "http://a/x"), (4, None)])
    labels = spark.createDataFrame([(12, 0, 1), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert tuples(urls.page_labels(found, labels), "page_id", "bad") == [(1, 1), (2, 1)]
    with pytest.raises(ValueError):
        urls.filter_urls(none.drop("url"), spark.createDataFrame([], NO_LABELS))
