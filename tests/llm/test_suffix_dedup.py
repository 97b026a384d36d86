import hashlib
import random

import numpy as np
import pytest

from innsight.llm import suffix_dedup as sd


def brute(rows):
    """(n_bytes, n_removed, n_spans, digest) by id, over every 100-byte window."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            w = raw[p:p + 100]
            if w in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(gone)))
        out[doc] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


def stitched(seed):
    """Texts stitched from pieces of one base, with periodic runs and multi-byte letters."""
    rng = random.Random(seed)
    base = "".join(rng.choice("ab ") for _ in range(2500))
    rows = []
    for i in range(50):
        text = ""
        for _ in range(rng.randrange(1, 7)):
            a = rng.randrange(0, 2300)
            text += base[a:a + rng.randrange(20, 400)] + rng.choice(["x", "", "yz" * rng.randrange(3)])
        if i % 7 == 0:
            text += "The " * rng.randrange(10, 120)
        if i % 9 == 0:
            text = "é" * rng.randrange(0, 200)
        rows.append((i * 7 % 101, text))
    return rows


def result(df):
    return {r[0]: tuple(r)[1:] for r in sd.remove_repeats(df, digest_only=True).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(docs_of, seed):
    assert result(docs_of(stitched(seed))) == brute(stitched(seed))


def test_slices_and_small_sorts_agree(spark, docs_of, monkeypatch):
    monkeypatch.setattr(sd, "CELLS", 5)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    data = b"".join(t.encode() for _, t in stitched(3))
    offsets = np.cumsum([0] + [len(t.encode()) for _, t in stitched(3)])
    row, low, high, anchor, gram, _ = sd.segments(np.frombuffer(data, np.uint8), offsets)
    raw = b"".join(data[a:b + 100] for a, b in zip(low, high))
    docs = [t.encode() for _, t in stitched(3)]
    found = set()
    for d, p in sd.repeated_windows(gram.view(np.int64), row.astype(np.int64), low - offsets[row], anchor - low, high - low, raw):
        found |= set(zip(d.tolist(), p.tolist()))
    seen, want = set(), set()
    for i, t in enumerate(docs):
        for p in range(len(t) - 99):
            if t[p:p + 100] in seen:
                want.add((i, p))
            seen.add(t[p:p + 100])
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert found == want


def test_without_the_bloom_filter(docs_of, monkeypatch):
    monkeypatch.setattr(sd, "BLOOM_BYTES", 0)  # positions join their texts
    assert result(docs_of(stitched(4))) == brute(stitched(4))


def test_suffix_order_and_extensions():
    rng = np.random.default_rng(1)
    table = rng.integers(0, 2, (300, 12)).astype(np.uint8)
    width = rng.integers(0, 13, 300)
    table[np.arange(12) >= width[:, None]] = 0
    group = np.sort(rng.integers(0, 9, 300))
    order, extension = sd.SuffixSorter(table, width).sort(group)
    words = [bytes(t[:w]) for t, w in zip(table, width)]
    assert order.tolist() == sorted(range(300), key=lambda i: (group[i], words[i], i))
    for i in range(1, 300):
        a, b = words[order[i - 1]], words[order[i]]
        common = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert extension[i] == (common if group[order[i]] == group[order[i - 1]] else -1)


def test_a_hash_collision_is_noticed():
    sorter = sd.SuffixSorter(np.array([[1, 2], [1, 3]], np.uint8), np.array([2, 2]))
    sorter.hash[1] = sorter.hash[0]
    with pytest.raises(ArithmeticError):
        sorter.sort(np.array([0, 0]))


def test_long_texts_in_slices():
    import pyarrow as pa

    text = "".join(random.Random(1).choice("abc") for _ in range(5000))
    old, sd.SLICE = sd.SLICE, 700
    try:
        batch = pa.RecordBatch.from_arrays([pa.array([4, 5]), pa.array(["short", text])], ["_row", "_text"])
        windows = set()
        for docs, data, offsets, base in sd._slices([batch]):
            row, low, high, *_ = sd.segments(data, offsets)
            for r, a, b in zip(row, low, high):
                for p in range(a, b + 1):
                    assert bytes(data[p:p + 100]) == text[p - offsets[r] + base[r]:][:100].encode()
                    windows.add((docs[r], p - offsets[r] + base[r]))
    finally:
        sd.SLICE = old
    assert windows == {(5, p) for p in range(4901)}


def test_odd_documents(docs_of, odd_docs):
    got = sorted((tuple(r) for r in sd.remove_repeats(docs_of(odd_docs), digest_only=True).collect()), key=str)
    order = sorted(odd_docs, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = brute(list(enumerate(t for _, t in order)))
    assert got == sorted(((order[k][0], *v) for k, v in want.items()), key=str)
    assert sd.remove_repeats(docs_of([])).collect() == []
    plain = sd.remove_repeats(docs_of([(1, "abc"), (2, None)])).collect()
    assert sorted((r.doc_id, bytes(r.kept)) for r in plain) == [(1, b"abc"), (2, b"")]
