import random
import re

import pytest
from pyspark.sql import functions as F

from innsight.llm import url_filter as uf
from innsight.llm.queries import URL_RULES

URLS = ["https://WWW.Example.com/en/5?x=1", "http://example.com/en/", "http://a.example.com/de/9#t", "https://x.net/es/1", "https://x.net/esx", "ftp://net/fr/",
        "https://other.org/en/1", "http://notexample.com/en/1", "no scheme", "", None, "http://", "http://com", "http://com/", "https://a.org?q=://b/en/", "http://u\nv.net/fr/\nz"]


def expected(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [(len(h + p), h + p, a) for a, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("_host", F.lit("clash"))
    for r in uf.filter_urls(df, URL_RULES).collect():
        host, path, rule, verdict = expected(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule), URLS[r.page_id]
        assert r.verdict == (verdict or "allow")


@pytest.fixture(scope="module")
def site(spark):
    """A host with a clean and a bad section, numbered pages in both, and a host of its own kind."""
    rows = [(f"http://h.org/{s}/page/{i}", s == "casino") for s in ("news", "blog", "casino") for i in range(40)]
    rows += [(f"http://bad.org/p{i}/x", True) for i in range(30)] + [("http://tiny.org/a", True), (None, False)]
    df = spark.createDataFrame([(i, u, i, int(b)) for i, (u, b) in enumerate(rows)], "page_id long, url string, k long, b int")
    bad = df.where("k % 2 = 0").select(F.col("k").alias("key"), F.col("b").alias("bad"))
    return rows, uf.filter_urls(df, [], bad, label_key=F.col("k")).collect()


def test_templates_generalise_and_bad_ones_go(site):
    rows, got = site
    by = {r.page_id: r for r in got}
    assert len(by) == len(rows)
    section = lambda s: {by[i].template for i, (u, _) in enumerate(rows) if u and f"/{s}/" in u}
    assert section("casino") == {"/=9/~/*/"}  # its labels differ from its siblings'; page numbers are a wildcard
    assert section("news") == section("blog") == {"/=1/~/*/"}  # alike: merged
    for i, (u, b) in enumerate(rows):
        if u and ("h.org" in u or "bad.org" in u):
            assert by[i].verdict == ("block" if b else "allow"), u
    assert by[len(rows) - 1].template == "/" and by[len(rows) - 1].host == ""


def test_smoothing_spares_templates_with_few_labels(site):
    rows, got = site
    tiny = next(r for r in got if r.host == "tiny.org")
    base = (20 + 15 + 1) / 76  # bad and labelled pages
    assert abs(tiny.bad_share - (1 + uf.PRIOR * base) / (1 + uf.PRIOR)) < 1e-9


def test_deep_paths_empty_tables_and_no_labels(spark):
    df = spark.createDataFrame([(1, "http://a.b/" + "/".join(f"s{i}" for i in range(30))), (1, "http://a.b/x")], "page_id long, url string")
    got = uf.filter_urls(df, []).collect()
    assert sorted(r.template for r in got) == sorted(["/" + "~/" * 8 + "**", "/~/"]) and {r.verdict for r in got} == {"allow"}
    assert uf.filter_urls(df.limit(0), URL_RULES).collect() == []


@pytest.mark.parametrize("shared", [7, 8, 11, 500])
def test_bad_sections_below_long_shared_paths_are_found(spark, shared):
    deep = "/".join(f"d{i}" for i in range(shared))
    rows = [(f"http://h.org/{deep}/{s}/more/{s[0]}/p{i}", s == "casino") for s in ("news", "casino", "blog") for i in range(30)]
    rows += [(f"http://h.org/{deep}", False), (f"http://h.org/{deep}/", False)]
    df = spark.createDataFrame([(i, u, i, int(b)) for i, (u, b) in enumerate(rows)], "page_id long, url string, k long, b int")
    got = {r.page_id: r for r in uf.filter_urls(df, [], df.where("k % 3 = 0").select(F.col("k").alias("key"), F.col("b").alias("bad")), label_key=F.col("k")).collect()}
    assert len(got) == len(rows)
    for i, (u, b) in enumerate(rows):
        assert got[i].verdict == ("block" if b else "allow"), (u, got[i].template)
    assert got[len(rows) - 1].template == "/" + "~/" * shared


def plain_templates(pages):
    """{position: template} by a plain recursion over (host, segments, label or None); a node's children are parted as the docstring says."""
    out = {}

    def grow(rows, at, template):
        ended = [r for r in rows if len(r[1]) == at]
        for r in ended:
            out[r[0]] = template
        rows = [r for r in rows if len(r[1]) > at]
        labels = [r[2] for r in rows if r[2] is not None]
        if at >= uf.ALWAYS and len(set(labels)) < 2:
            for r in rows:
                out[r[0]] = template + "**"
            return
        kids = {}
        for r in rows:
            kids.setdefault(r[1][at], []).append(r)
        groups = {}
        for kid in kids.values():
            mine = [r[2] for r in kid if r[2] is not None]
            l, b, nl, nb = len(mine), sum(mine), len(labels), sum(labels)
            branch = "~"
            if len(kids) > uf.FANOUT and len(kids) > uf.SPREAD * len(rows):
                branch = "*"
            elif l and nl > l:
                p = nb / nl
                if abs(b / l - (nb - b) / (nl - l)) > uf.Z * (p * (1 - p) * (1 / l + 1 / (nl - l))) ** 0.5:
                    branch = f"={int(uf.LEVELS * (b + uf.PRIOR * p) / (l + uf.PRIOR) + 0.5)}"
            groups.setdefault(branch, []).extend(kid)
        for branch, members in groups.items():
            grow(members, at + 1, f"{template}{branch}/")

    hosts = {}
    for i, (host, segments, label) in enumerate(pages):
        hosts.setdefault(host, []).append((i, segments, label))
    for rows in hosts.values():
        grow(rows, 0, "/")
    return out


def test_learned_verdicts_equal_a_plain_recursion(spark):
    rng = random.Random(5)
    words = ["news", "casino", "blog", "shop"]
    pages = []
    for _ in range(600):
        host = rng.choice(["a.org", "a.org", "b.org", "c.net"])
        segments = [rng.choice(words[:2]) if rng.random() < 0.8 else rng.choice(words + [f"p{rng.randrange(99)}"]) for _ in range(rng.choice([1, 2, 3, 3, 12]))]
        if len(segments) > 3:
            segments[:9] = ["x"] * rng.choice([8, 9])
        label = None if rng.random() < 0.3 else int(rng.random() < (0.9 if "casino" in segments else 0.1))
        pages.append((host, segments, label))
    df = spark.createDataFrame([(i, f"http://{h}/{'/'.join(s)}") for i, (h, s, _) in enumerate(pages)], "page_id long, url string")
    bad = spark.createDataFrame([(i, label) for i, (_, _, label) in enumerate(pages) if label is not None], "key long, bad int")
    want = plain_templates(pages)
    sums = {}
    for i, (h, _, label) in enumerate(pages):
        l, b = sums.get((h, want[i]), (0, 0))
        sums[h, want[i]] = (l + (label is not None), b + (label or 0))
    base = sum(b for _, b in sums.values()) / sum(l for l, _ in sums.values())
    got = {r.page_id: r for r in uf.filter_urls(df, [], bad, label_key=F.col("_id")).collect()}
    assert {i: r.template for i, r in got.items()} == want
    for i, (h, _, _) in enumerate(pages):
        l, b = sums[h, want[i]]
        share = (b + uf.PRIOR * base) / (l + uf.PRIOR)
        assert abs(got[i].bad_share - share) < 1e-9 and got[i].verdict == ("block" if share >= uf.REJECT else "allow")
    assert {r.verdict for r in got.values()} == {"allow", "block"} and len(set(want.values())) > 12


def test_long_urls_and_repeated_rows(spark):
    rows = [(1, "http://a.b/" + "x" * 1_000_000), (2, "http://a.b/" + "y/" * 50_000), (3, "http://a.b/c?d"), (3, "http://a.b/c?d"), (4, "http://" + "h" * 100_000)]
    got = uf.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).collect()
    assert sorted(r.page_id for r in got) == [1, 2, 3, 3, 4]
    assert {r.page_id: len(r.path) for r in got}[1] == 1_000_001
