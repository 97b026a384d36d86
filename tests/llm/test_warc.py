import hashlib
import random

import pytest
from pyspark.sql import functions as F

from innsight.llm import warc

TRICKY = "<p>WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n</p>" + "é" * 80


def rows():
    big = "".join(random.Random(1).choice("<>ab\r\n ") for _ in range(40_000))
    return [(5, "http://B.example.com/x?q=1", TRICKY), (3, "http://a.example.com/", TRICKY), (9, "http://a.example.com/", TRICKY), (1, "http://a.example.com/", "short"),
            (2, "http://a.example.com/", "short"), (4, None, None), (6, "http://h/\r\nInjected: x", ""), (None, "http://n/", "n" * 120), (8, "http://n/", "n" * 120),
            (7, "http://big/", big), (7, "http://big/", big), (10, "http://z/", "y" * 99), (11, "http://z/", "y" * 99), (12, "http://z/", "w" * 100), (13, "http://z/", "w" * 100)]


def expected():
    first = {}
    for i, _, h in rows():
        if len((h or "").encode()) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    out = []
    for i, _, h in rows():
        raw = (h or "").encode()
        f = first.get(h)
        revisit = f is not None and i != f
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def index(spark):
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string").withColumn("_digest", F.lit("clash")).repartition(3)
    return warc.archive_pages(pages).collect()


def test_round_trip(index):
    assert sorted((tuple(r)[:5] for r in index), key=str) == expected()


def test_histories_are_in_global_order(index):
    keys = [warc._order(tuple(r)) for r in sorted(index, key=lambda r: (r.index_part, r.index_position))]
    assert keys == sorted(keys) and [r.url_key for r in index if r.page_id == 5] == ["com,example,b)/x?q=1"]


def test_records_can_be_read_at_their_offsets(index):
    for r in index:
        with open(r.archive.removeprefix("file:"), "rb") as f:
            f.seek(r.record_offset)
            data = f.read(r.record_length)
        (headers, block, end, start), = warc.parse_records(data)
        assert (start, end + 4) == (0, len(data)) and headers["WARC-Type"] == r.record_type and "Injected" not in headers


def test_damage_is_noticed():
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))
    with pytest.raises(ValueError):
        list(warc.parse_records(b"junk"))


def test_loser_tree_merges():
    rng = random.Random(2)
    for k in (1, 2, 3, 7, 8, 20):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(0, 30))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_empty_table(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
