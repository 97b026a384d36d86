import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from innsight.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth int, seq string, own long"


def sequences(rows, block):
    conv = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            x = (role or "", text or "")
            digest = hashlib.sha256(f"{len(x[0])}:{x[0]}{x[1]}".encode()).digest()[:16]
            conv[c].append(((t is not None, t or 0, digest), x))
    conv = {c: [x for _, x in sorted(v)] for c, v in conv.items()}
    if not block:
        return {c: tuple(v) for c, v in conv.items()}
    return {c: tuple(conv.get(c - int(math.fmod(c, 100)), [])[:zlib.crc32(str(c).encode()) % 6] + own[zlib.crc32(str(c).encode()) % 6:]) for c, own in conv.items()}


def brute(rows, block=True):
    conv = sequences(rows, block)
    members = defaultdict(list)
    for c, s in conv.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for s in members:
        if s:
            children[s[:-1]] += 1
    for s, m in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += children[s] == 0
            saved[s[:d]] += (len(m) - 1) * len(s[-1][1]) if s else 0
    return sorted(((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), children[s], leaves[s], saved[s],
                    hashlib.sha256(",".join(map(str, sorted(c for c in m if len(conv[c]) == len(s)))).encode()).hexdigest()) for s, m in members.items()), key=str)


def found(spark, rows, block=True):
    turns = spark.createDataFrame([(*r, "x", 0, "y", 1) for r in rows], SCHEMA).repartition(5)
    made = ct.conversations(turns, 100, F.crc32(F.col("conv_id").cast("string")) % 6) if block else ct.conversations(turns)
    return sorted(map(tuple, ct.prefix_trie(made).collect()), key=str)


def tree_rows(n, seed):
    """Conversations that share turns at every depth, a third of them copies of one."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        turns = ["hi", "same", "again"] if c % 3 == 0 else [f"t{rng.randrange(3)}" * rng.randrange(1, 4) for _ in range(rng.randrange(1, 9))]
        rows += [(c, k, ("user", "assistant")[k % 2], x) for k, x in enumerate(turns)]
    return rows


ODD = [
    (1, None, None, None), (1, 0, "", ""), (1, 0, "user", "tie"), (1, 0, "user", "tie"), (1, 0, "bot", "tie"), (2, 5, "user", "é😀 long " * 50_000), (2, 1, None, "x"),
    (None, 0, "user", "nobody"), (None, None, None, None), (300, 0, "user", "a"), (301, 0, "user", "a"), (302, 1, "a", "b:c"), (303, 1, "a:b", "c"), (400, 9, "user", ""),
    (-100, 0, "user", "minus"), (-99, 1, "user", "minus"), (10 ** 15, 0, "user", "a"),
]


@pytest.mark.parametrize("rows", [ODD, tree_rows(400, 1), tree_rows(40, 2)], ids=["odd", "shared", "few"])
def test_nodes_equal_brute_force(spark, rows):
    assert found(spark, rows) == brute(rows)


def test_without_splicing(spark):
    rows = tree_rows(150, 3)
    assert found(spark, rows, block=False) == brute(rows, block=False)


def test_shards_of_few_turns_and_short_pieces(spark, monkeypatch):
    """Many boundary nodes, and ids of one node in many pieces, give the same."""
    monkeypatch.setattr(ct, "SHARD_TURNS", 20)
    monkeypatch.setattr(ct, "PIECE", 8)
    rows = tree_rows(400, 4)
    assert found(spark, rows) == brute(rows)


def test_long_conversation(spark):
    rows = [(c, k, "user", f"turn {k}") for c in (1, 2) for k in range(3000 + c)]
    got = found(spark, rows, block=False)
    assert len(got) == 3003
    assert got == sorted(((1 if d <= 3001 else 2, d, None if d == 0 else 1, 2 if d <= 3001 else 1, int(d < 3002), 1, sum(len(f"turn {k}") for k in range(max(d - 1, 0), 3001)),
                           hashlib.sha256({3001: b"1", 3002: b"2"}.get(d, b"")).hexdigest()) for d in range(3003)), key=str)


def test_empty_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "x")]) == []


def test_turnless_conversations_end_at_the_root(spark):
    rows = [(c, 0, "user", "only") for c in range(101, 130)]  # their block has no head
    assert found(spark, rows) == brute(rows)
    assert any(len(s) == 0 for s in sequences(rows, True).values())


def test_tree_nodes_are_prefixes_and_median_insertion_balances():
    rng = random.Random(0)
    seqs = sorted({tuple(rng.randrange(50) for _ in range(rng.randrange(0, 5))) for _ in range(500)})
    tree = ct.TernaryTree()
    order = list(ct.medians(len(seqs)))
    assert sorted(order) == list(range(len(seqs)))
    for k in order:
        assert len(tree.insert(list(seqs[k]))) == len(seqs[k]) + 1
    assert len(tree.split) == len({s[:d] for s in seqs for d in range(len(s) + 1)})
    walk = tree.walk()
    place = {n: i for i, n in enumerate(walk)}
    assert sorted(walk) == list(range(len(tree.split))) and all(place[tree.up[n]] < place[n] for n in walk if n)
    flat = ct.TernaryTree()
    for k in ct.medians(1023):
        flat.insert([k])

    def height(n):
        return 0 if n < 0 else 1 + max(height(flat.lo[n]), height(flat.hi[n]))

    assert height(flat.eq[0]) == 10
