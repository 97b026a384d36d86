import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from innsight.llm import ngram_join as nj
from innsight.llm.components import components
from innsight.llm.util import concat_text, shingle_rows

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_set(text):
    w = WORD.findall((text or "").encode().translate(LOWER))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def brute(rows):
    """(n_shingles, component) of each row, in order."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted(((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))), key=str)


def family_rows(seed):
    """Families of edited copies, a passage in most texts, chains of links near the threshold."""
    rng = random.Random(seed)
    passage = " ".join(f"common{i}" for i in range(25))
    rows = []
    for f in range(25):
        words = [f"f{f}w{i}" for i in range(rng.randrange(8, 160))]
        for _ in range(rng.randrange(1, 9)):
            own = list(words)
            for _ in range(rng.randrange(0, 1 + len(words) // 25)):
                own[rng.randrange(len(own))] = f"edit{rng.random()}"
            if rng.random() < 0.3:
                words = own
            text = " ".join(own)
            if rng.random() < 0.6:
                text = text + " " + passage if rng.random() < 0.5 else passage.upper() + "\n" + text
            rows.append((len(rows) * 3 % 1009, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(docs_of, seed, monkeypatch):
    monkeypatch.setattr(nj, "CHUNK", 16)  # blocks in several chunks, centres with several meetings
    rows = family_rows(seed)
    got = nj.jaccard_components(docs_of(rows).withColumn("class", F.lit("clash"))).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def linked_in_pairs_of_classes():
    """Families of 14 copies that are too far apart to link but whose bitmaps may pass, each with one linked pair.

    Words at multiples of five are edited, so an edit changes five shingles.  The copies ``a`` and ``b`` share rare
    shingles with nobody else; ``a`` has so many rare ones that it meets no other in a frequent one, and shares
    each edit that ``b`` lacks with one of the others.
    """
    rng = random.Random(5)
    rows = []
    for f in range(3):
        words = [f"f{f}w{i}" for i in range(516)]
        slots = rng.sample(range(100), 100)
        a, b = list(words), list(words)
        for k in slots[:21]:
            a[5 * k + 4] = f"f{f}a{k}"
        for k in slots[9:21]:
            b[5 * k + 4] = f"f{f}a{k}"
        copies = [a, b]
        for i in range(12):
            own = list(words)
            for k in rng.sample(slots[21:], 8):
                own[5 * k + 4] = f"f{f}x{i}k{k}"
            if i < 9:
                own[5 * slots[i] + 4] = f"f{f}a{slots[i]}"
            copies.append(own)
        rows += [(len(rows) + i, " ".join(c)) for i, c in enumerate(copies)]
    return rows


def test_links_of_blocks_of_two_classes_are_kept(docs_of):
    rows = linked_in_pairs_of_classes()
    want = brute(rows)
    assert len({c for _, _, c in want}) == 3 * 13  # only a and b link
    got = nj.jaccard_components(docs_of(rows, parts=1)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == want


def test_odd_documents(docs_of, odd_docs):
    got = nj.jaccard_components(docs_of(odd_docs)).select("doc_id", "n_shingles", "component_id").collect()
    want = [(i, n, c if n else i) for i, n, c in brute(odd_docs)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert nj.jaccard_components(docs_of([])).collect() == []


def test_one_of_each_group_stays(docs_of):
    a = " ".join(f"w{i}" for i in range(60))
    rows = [(5, a), (3, a), (None, a), (3, a), (7, a.replace("w30", "x")), (1, None), (1, None), (2, ""), (4, "one two"), (9, "One\ttwo"), (None, "zz"), (7, "own text")]
    kept = nj.keep_one_of_each_group(docs_of(rows).withColumn("_row", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "_row"]
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(3, a), (1, None), (1, None), (2, ""), (4, "one two"), (None, "zz"), (7, "own text")], key=str)


def test_tree_finds_every_pair_that_links():
    rng = random.Random(7)
    base = [[rng.getrandbits(60) for _ in range(rng.choice([6, 40, 90, 100, 110, 400]))] for _ in range(30)]
    sets = []
    for b in base:
        for _ in range(6):
            s = set(b)
            for x in rng.sample(b, rng.randrange(0, 1 + len(b) // 6)):
                s.discard(x)
                s.add(rng.getrandbits(60))
            sets.append(s)
    rows = [{"class": i, "size": len(s), "root": i, "bitmap": nj._bitmap(np.array(sorted(s), np.uint64))} for i, s in enumerate(sets)]
    links = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    found = {(min(p), max(p)) for p in nj.tree_candidates(rows)}
    assert links <= found and len(found) < len(sets) ** 2 / 8
    split = nj.tree_candidates(rows[:90], rows[90:])
    assert {p for p in links if p[0] < 90 <= p[1]} <= {(min(p), max(p)) for p in split}
    keyed = [{**r, "keys": [3, 5, 9] if r["class"] % 2 else [5, 9]} for r in rows]
    per_key = {k: {(min(p), max(p)) for p in nj.tree_candidates([r for r in keyed if k in r["keys"]], key=k)} for k in (3, 5, 9)}
    assert per_key[3] | per_key[5] == found and not per_key[3] & per_key[5] and not per_key[9]
    same = [{**r, "root": 1} for r in rows]
    assert nj.tree_candidates(same) == []  # one component: nothing to look for


def test_shingles_of_a_batch():
    import pyarrow as pa

    texts = ["a b c d e f a b c d e", "", None, "A\tB", "x" * 5000, " lead trail ", "é É e"]
    row, seq = shingle_rows(*concat_text(pa.array(texts)), 5)
    n = Counter(row.tolist())
    assert [n[i] for i in range(len(texts))] == [len(shingle_set(t)) for t in texts]
    lower = shingle_rows(*concat_text(pa.array(["a b"])), 5)[1]
    assert seq[row == 3].tolist() == lower.tolist()


def test_word_hashes_do_not_depend_on_the_parts():
    from innsight.llm.util import _word_hashes

    data = np.frombuffer(b"ab cd ab " + b"x" * 50 + b" ab", np.uint8)
    start, end = np.array([0, 3, 6, 9, 60]), np.array([2, 5, 8, 59, 62])
    whole, parts = _word_hashes(data, start, end), _word_hashes(data, start, end, part=4)
    assert whole.tolist() == parts.tolist() and len(set(whole.tolist())) == 3


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60) if i != 30] + [(5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 0 if i <= 30 else 31 for i in range(61)}


def test_a_block_is_finished_when_its_forest_holds_all_candidates():
    import pyarrow as pa

    def rows(sets, first):
        return [{"class": first + i, "size": len(s), "root": first + i, "bitmap": nj._bitmap(np.array(sorted(s), np.uint64)), "keys": None} for i, s in enumerate(sets)]

    base = [[mine * 1000 + k for k in range(50)] for mine in range(3)]
    near = [base[0], base[0][1:], base[0][2:]]  # three candidates, two of them a forest
    blocks = {7: rows(near, 10), 8: rows([*base, base[1][1:]], 20), 9: rows(base, 30)}
    kind = pa.list_(pa.struct([("class", pa.int64()), ("size", pa.int64()), ("root", pa.int64()), ("bitmap", pa.binary()), ("keys", pa.list_(pa.int64()))]))
    batch = pa.RecordBatch.from_arrays([pa.array(list(blocks)), pa.array([False] * 3), pa.array(list(blocks.values()), kind), pa.nulls(3, kind)], ["key", "large", "rows", "other"])

    def found(forest):
        return [r for b in nj._search(forest)([batch]) for r in b.to_pylist()]

    assert [r["unfinished"] for r in found(0) if r["unfinished"] is not None] == [7]
    pairs = [(r["a"], r["b"]) for r in found(0) if r["unfinished"] is None]
    assert len(pairs) == 3 and (21, 23) in pairs
    every = found(None)
    assert len(every) == 4 and all(r["unfinished"] is None for r in every)


def test_narrow_bitmaps_keep_every_class_that_links():
    import pyarrow as pa

    rng = random.Random(3)
    base = [[rng.getrandbits(60) for _ in range(n)] for n in (1, 5, 30, 120, 130, 700)]
    sets = [set(b) for b in base] + [{*b[: len(b) - len(b) // 12], *(rng.getrandbits(60) for _ in range(len(b) // 14))} for b in base[2:]]
    wide = pa.RecordBatch.from_arrays([pa.array(range(len(sets))), pa.array([len(s) for s in sets]), pa.array([nj._bitmap(np.array(sorted(s), np.uint64)) for s in sets], pa.binary())], ["class", "size", "wide"])
    both = next(nj._add_narrow([wide]))
    assert both.column(3).to_pylist() == [nj._bitmap(np.array(sorted(s), np.uint64), nj.NARROW_BITS) for s in sets]
    rows = [{"class": i, "size": len(s), "root": i, "bitmap": both.column(3)[i].as_py(), "keys": None} for i, s in enumerate(sets)]
    kind = pa.list_(pa.struct([("class", pa.int64()), ("size", pa.int64()), ("root", pa.int64()), ("bitmap", pa.binary()), ("keys", pa.list_(pa.int64()))]))
    batch = pa.RecordBatch.from_arrays([pa.array([4, 5]), pa.array([rows, rows[:5]], kind), pa.array([None, rows[5:]], kind)], ["key", "rows", "other"])
    links = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert len(links) == 4
    got = {r["key"]: set(r["classes"]) for r in next(nj._with_candidates([batch])).to_pylist()}
    assert got[4] >= {x for p in links for x in p} and 0 not in got[4] and 1 not in got[4]
    assert got[5] >= {x for p in links if p[0] < 5 <= p[1] for x in p}


def chained(plan):
    """Whether a plan (a text with a node a line) has two Python functions in one stage."""
    above = []  # of each node from the top to the line's: whether a Python function stands at or over it in its stage
    for line in plan.splitlines():
        if not (m := re.match(r"([ :|+*()0-9-]*)([A-Z]\w*)", line)):
            continue
        depth, node = len(re.match(r"[ :|+-]*", line)[0]) // 3, m[2]
        python = bool(re.search("InArrow|InPandas|Python", node))
        over = above[depth - 1] if depth and "Exchange" not in node else False
        if python and over:
            return True
        above[depth:] = [python or over]
    return False


def test_tasks_have_one_python_worker(spark, docs_of, monkeypatch):
    """No stage of the join has two Python functions: each would keep a worker of its own, which stays for the stages that follow."""
    plans = []

    def kept(df, name):
        plans.append((name, df._jdf.queryExecution().sparkPlan().toString()))
        return written(df, name)

    written = nj.written
    monkeypatch.setattr(nj, "written", kept)
    rows = family_rows(3)[:60]
    assert sorted(((r[0], r[1], r[2]) for r in nj.jaccard_components(docs_of(rows)).collect()), key=str) == brute(rows)
    assert {"signatures", "verified", "tree"} <= {name for name, _ in plans}
    assert sum("MapInArrow" in plan for _, plan in plans) >= 8
    assert not [name for name, plan in plans if chained(plan)]
    twice = spark.range(9).mapInArrow(lambda b: b, "id long").mapInArrow(lambda b: b, "id long")
    assert chained(twice._jdf.queryExecution().sparkPlan().toString())


def test_shingles_in_parts_are_those_of_the_whole():
    """Cuts between parts change nothing (empty, null, short and long rows), and a batch of 4 MB takes under 40 MB of work (87 before)."""
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(5)
    texts = [None, "", " ", "one", "One two"] * 9 + [" ".join(rng.choice("aBcdefgh") for _ in range(rng.randrange(60))) + rng.choice(["", " ", "\n"]) for _ in range(300)]
    rng.shuffle(texts)
    data, offsets = concat_text(pa.array(texts, pa.string()))
    whole = shingle_rows(data, offsets, part=1 << 30)
    for part in (1, 50, 1000):
        for a, b in zip(shingle_rows(data, offsets, part=part), whole):
            assert a.dtype == b.dtype and a.tolist() == b.tolist()
    data, offsets = concat_text(pa.array([" ".join(str(rng.randrange(10_000)) for _ in range(800)) for _ in range(1050)]))
    assert len(data) > 4_000_000  # 800,000 words
    tracemalloc.start()
    row, _ = shingle_rows(data, offsets)
    assert tracemalloc.get_traced_memory()[1] < 40 << 20 and len(set(row.tolist())) == 1050
    tracemalloc.stop()
