import re
from collections import defaultdict
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from innsight.llm.filter_audit import audit, removal_ranks

DOCS = "doc_id long, text string, source string, mask string, part int, n int"
LABELS = "doc_id long, quality int, toxic int, good string, id int"


def brute(docs, labels):
    marks = defaultdict(lambda: [0, 0])
    for i, q, t, *_ in labels:
        if i is not None:
            marks[i][0] |= q == 1
            marks[i][1] |= t == 1
    least = {}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = defaultdict(lambda: [0] * 7)
    for i, t, s, *_ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
               "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        good, toxic = marks[i] if i is not None else (0, 0)
        for order in permutations("ABCDE"):
            gone = False
            for k, f in enumerate(order):
                row = out[(s or "", "".join(order), k + 1)]
                hit = bad[f] and not gone
                row[2] += bad[f] and gone
                row[3] += bad[f] and sum(bad.values()) == 1
                gone |= bad[f]
                row[0] += not gone
                row[1] += hit
                row[4] += hit and good
                row[5] += hit and toxic
    shapley = defaultdict(int)
    for (s, o, k), row in out.items():
        shapley[s, o[k - 1]] += row[1]
    return {key: (*map(int, row[:6]), shapley[key[0], key[1][key[2] - 1]]) for key, row in out.items()}


def found(spark, docs, labels):
    rows = audit(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(got) == len(rows)
    return got


def documents():
    long = " ".join(f"word{i}" for i in range(400))
    texts = [None, "", " \t\n", long, long, long + " #", "Shout " * 300, "a b " * 200, "HELLO " + long, long + " \x1c \x85é", "x" * 300_000,
             " ".join(f"t{i}" for i in range(60_000)), " " * 100_000, "\n" * 100_000, "#" * 100_000]
    rows = [(i, t, ("web", "web", "", None, "code")[i % 5], "m", i, 0) for i, t in enumerate(texts)]
    rows += [(100 + i, "hot copy", "web", "m", 0, 0) for i in range(300)]
    rows += [(None, "hot copy", "web", "m", 0, 0), (None, None, None, None, None, None), (100, "hot copy", "web", "m", 0, 0), (100, "hot copy", "code", "m", 0, 0), (7, long, "web", "m", 0, 0)]
    return rows


def test_audit_equals_brute_force(spark):
    labels = [(0, 1, 0, "g", 1), (3, 1, 1, "g", 1), (3, 0, 0, "g", 1), (4, 1, None, "g", 1), (5, None, 1, "g", 1), (105, 1, 1, "g", 1), (None, 1, 1, "g", 1), (9999, 1, 1, "g", 1)]
    assert found(spark, documents(), labels) == brute(documents(), labels)
    assert found(spark, documents(), []) == brute(documents(), [])


def test_empty_table_gives_no_rows(spark):
    assert found(spark, [], [(1, 1, 1, "g", 1)]) == {}


def test_counts_fit_together(spark):
    rows = found(spark, documents(), [])
    orders = ["".join(p) for p in permutations("ABCDE")]
    for part in {k[0] for k in rows}:
        assert len({rows[part, o, 5][0] for o in orders}) == 1  # what stays does not depend on the order
        for f in "ABCDE":
            assert len({sum(rows[part, o, o.index(f) + 1][1:3]) for o in orders}) == 1  # removed + redundant = failing


def test_ranks_are_the_min_plus_product():
    orders = np.array(list(permutations(range(3))))
    ranks = removal_ranks(orders)
    for m in range(8):
        for p, order in enumerate(orders):
            steps = [k + 1 for k, f in enumerate(order) if m >> f & 1]
            assert ranks[m, p] == (min(steps) if steps else np.inf)


def test_other_filters(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bb")], "doc_id long, text string").withColumn("source", F.lit("s"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = audit(docs, labels, "Z", lambda t: {"L": F.length(t) > 1}).collect()
    assert {(r.filter_order, r.step): (r.kept, r.removed) for r in rows} == {("LZ", 1): (2, 1), ("LZ", 2): (1, 1), ("ZL", 1): (2, 1), ("ZL", 2): (1, 1)}
