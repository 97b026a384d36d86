import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from innsight.llm import packing, util
from innsight.llm.packing import best_fit_decreasing, lower_bound, pack, token_pieces
from innsight.llm.util import ARROW_BYTES, small_batches, written

PATH = public_tokenizers.path("byte_bpe_50k.json")


def fewest_bins(lengths, capacity):
    """Exact minimum by search over placements."""
    best = len(lengths)

    def place(i, free):
        nonlocal best
        if len(free) >= best:
            return
        if i == len(lengths):
            best = len(free)
            return
        for k in {f: j for j, f in enumerate(free) if f >= lengths[i]}.values():
            place(i + 1, [f - lengths[i] * (j == k) for j, f in enumerate(free)])
        place(i + 1, [*free, capacity - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=8))
def test_bounds_hold_and_packing_is_valid(lengths):
    place, offset, fill = best_fit_decreasing(np.array(lengths), 30)
    for b in range(len(fill)):
        spans = sorted((offset[i], offset[i] + n) for i, n in enumerate(lengths) if place[i] == b)
        assert spans[0][0] == 0 and spans[-1][1] == fill[b] <= 30 and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
    least = fewest_bins(lengths, 30)
    assert lower_bound(np.array(lengths), 30) <= least <= len(fill)


def reference_pieces(rows):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    out = []
    for doc, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        out += [(doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def packed(docs_of, odd_docs):
    return pack(token_pieces(docs_of(odd_docs + [(11, "<|endoftext|> is text"), (12, "naïve 日本語 🙂  \n\n x")]), PATH)).collect()


def test_pieces_are_those_of_the_tokenizers_library(packed, odd_docs):
    rows = odd_docs + [(11, "<|endoftext|> is text"), (12, "naïve 日本語 🙂  \n\n x")]
    assert sorted((tuple(r)[:5] for r in packed), key=str) == reference_pieces(rows)


def test_registered_query_takes_added_tokens_as_the_library_does(spark, scratch):
    from innsight.llm.queries import op2_packing

    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n y", "<|endoftext|", "naïve <|endoftext|>日本語  ", "", "word " * 3000 + "<|endoftext|> end"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{scratch}/documents.parquet")
    t = Tokenizer.from_file(PATH)
    assert t.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    want = []
    for doc, text in enumerate(texts):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(tuple(r)[:5] for r in op2_packing(spark, scratch).collect()) == want


def test_sequences_are_gapless(packed):
    by = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 1024 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_partitions_with_gaps_exchange_pieces(spark, monkeypatch):
    rng = np.random.default_rng(3)
    lengths = rng.integers(200, 700, 1200).tolist()
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(lengths)], "doc_id long, length long, _row string")
    alone = pack(df, 1024, part_pieces=10**6).select("sequence_id").distinct().count()
    parts = pack(df, 1024, part_pieces=100)
    got = parts.select("doc_id", "length", "_row").collect()
    assert sorted((r.doc_id, r.length) for r in got) == list(enumerate(lengths)) and {r._row for r in got} == {"x"}
    bins = parts.select("sequence_id").distinct().count()
    full = parts.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count()
    monkeypatch.setattr(packing, "MAX_ROUNDS", 1)
    once = pack(df, 1024, part_pieces=100).select("sequence_id").distinct().count()
    assert full == 0 and lower_bound(np.array(lengths), 1024) <= alone <= bins <= once


def test_empty_table(docs_of):
    assert pack(token_pieces(docs_of([]), PATH)).collect() == []


def test_long_white_space_runs(docs_of):
    """A megabyte of blanks or line breaks is encoded as the library encodes it."""
    rows = [(1, " " * 1_000_000), (2, "\n" * 1_000_000), (3, "a" + " " * 300_000 + "b <|endoftext|>"), (4, "." * 300_000), (5, None)]
    assert sorted(map(tuple, token_pieces(docs_of(rows), PATH).collect()), key=str) == reference_pieces(rows)


def test_long_rows_reach_the_workers_in_small_batches(spark):
    """Batches are bounded by bytes, not by rows alone (one of 20 MB before), and the session's setting comes back."""

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    rows = spark.range(0, 9000, 1, 1).select("id", F.repeat(F.lit("x"), 2000).alias("t"))
    n, size = written(rows.mapInArrow(sizes, "n long, bytes long"), "batches").agg(F.sum("n"), F.max("bytes")).first()
    assert n == 9000 and size < 1.1 * ARROW_BYTES and spark.conf.get(key) == before


def test_setting_comes_back_after_a_failure(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, "9m")
    with pytest.raises(ZeroDivisionError), small_batches(spark):
        assert spark.conf.get(key) == str(ARROW_BYTES)
        1 / 0
    assert spark.conf.get(key) == "9m"
    spark.conf.unset(key)


def test_workers_keep_small_tables_of_powers(monkeypatch):
    """After a batch of 3 MB a worker keeps under 8 MB of powers (48 MB before); it stays for the stages that follow."""
    import pyarrow as pa

    for name, base in (("POWERS", util._BASE), ("INVERSE", pow(util._BASE, -1, 1 << 64))):
        monkeypatch.setattr(util, name, util.Powers(base))
    util.shingle_rows(*util.concat_text(pa.array(["some words of a text " * 150_000])))
    assert 0 < util.POWERS._p.nbytes + util.INVERSE._p.nbytes < 8 << 20
