import math

import numpy as np
import pytest

from innsight.llm import cover_tree as ct

SCHEMA = "vec_id long, embedding array<{}>, label int, name string, n int, cell int"


def brute(rows):
    """(id, links, component, kept) by all pairs."""
    fine = [v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if fine[i] and fine[j] and len(a) == len(b) and ct._linked(ct.unit([np.array(a, "<f8").tobytes()], "<f8", len(a))[0], ct.unit([np.array(b, "<f8").tobytes()], "<f8", len(b))[0]):
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[top(i)] = min(k, least.get(top(i), k))
    out = []
    for i, (k, _) in enumerate(rows):
        component = least.get(top(i)) if fine[i] else k
        out.append((k, links[i], component, k == component))
    return sorted(out, key=str)


def found(spark, rows, kind="double"):
    df = spark.createDataFrame([(i, v, 0, "x", 1, 2) for i, v in rows], SCHEMA.format(kind)).repartition(3)
    return sorted(map(tuple, ct.near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def clustered(n, dim, seed, hot=3):
    """Unit vectors: every ``hot``-th near one direction, the others in small families and alone."""
    rng = np.random.default_rng(seed)
    main, families = rng.normal(size=dim), rng.normal(size=(n // 10 + 1, dim))
    out = []
    for i in range(n):
        v = main + rng.normal(size=dim) * rng.choice([0.05, 0.3, 0.45]) if i % hot == 0 else families[rng.integers(len(families))] + rng.normal(size=dim) * rng.choice([0.01, 0.3, 2.0])
        out.append((i, (v / np.linalg.norm(v)).astype(np.float32).astype(float).tolist()))
    return out


@pytest.mark.parametrize("dim", [2, 5, 32])
def test_links_and_components_equal_brute_force(spark, dim):
    rows = clustered(300, dim, dim)
    assert found(spark, rows) == brute(rows)


def test_many_blocks_and_cells(spark, monkeypatch):
    monkeypatch.setattr(ct, "BLOCK", 20)
    monkeypatch.setattr(ct, "PARTNERS", 3)
    for dim in (3, 24):
        rows = clustered(260, dim, 7)
        rows += [(1000 + i, rows[5][1]) for i in range(100)]  # copies of one
        assert found(spark, rows, "float") == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [2.0, -0.0]), (9, [1e300, 1e200]),
            (10, [1e-300, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [5.0]), (13, [0.1]), (14, [-1.0]), (None, [1.0, 0.01]), (None, [0.0, 1.0]), (None, None), (15, [-1.0, 0.0])]
    got = found(spark, rows)
    assert got == brute(rows)
    assert {r[0]: r[2] for r in got if r[0]}[10] == 7
    assert found(spark, []) == []


def test_threshold_is_met_exactly(spark):
    """Pairs at and just below 0.9 are told apart."""
    rows = []
    for k in range(40):
        angle = math.acos(0.9) * (1 + (k - 20) * 1e-12)
        rows += [(2 * k, [10.0 ** k, 0.0] if k % 2 else [1.0, 0.0]), (2 * k + 1, [math.cos(angle), math.sin(angle)])]
    assert found(spark, rows) == brute(rows)


def test_tree_covers_and_halves():
    points = ct.unit([np.array(v, "<f8").tobytes() for _, v in clustered(500, 4, 1)], "<f8", 4)
    order, (start, end, kid, kid_end), radius = ct.build(points)
    assert sorted(order) == list(range(500))
    p = points[order]
    for i in range(len(start)):
        assert np.linalg.norm(p[start[i]:end[i]] - p[start[i]], axis=1).max() <= radius[i] + 1e-12
        if kid[i] < kid_end[i]:
            kids = range(kid[i], kid_end[i])
            assert start[kids[0]] == start[i] and end[kids[-1]] == end[i] and all(end[k] == start[k + 1] for k in kids[:-1])
            half = 2.0 ** (math.ceil(math.log2(radius[i])) - 1)
            assert radius[i] / 2 <= half < radius[i] and all(radius[k] <= half + 1e-9 for k in kids)
            centres = p[[start[k] for k in kids]]
            apart = np.linalg.norm(centres[:, None] - centres[None], axis=2) + 9 * np.eye(len(centres))
            assert apart.min() > half - 1e-9


def test_traversal_compares_few_points_of_separate_groups(monkeypatch):
    """Groups that lie apart are dropped by their radii, and tight ones are linked without comparing their points."""
    rng = np.random.default_rng(0)
    groups = np.eye(16)[rng.integers(0, 16, 4000)] + rng.normal(size=(4000, 16)) * 0.002
    points = groups / np.linalg.norm(groups, axis=1)[:, None]
    order, nodes, radius = ct.build(points)
    tree = ct.CoverTree(points[order], np.ones(4000, np.int64), nodes.astype(np.int64), radius)
    seen = []
    monkeypatch.setattr(ct.Links, "points", lambda self, p, q, old=ct.Links.points: (seen.append(len(p)), old(self, p, q))[1])
    links = ct.dual_traversal(tree, tree, True)
    every = points[order] @ points[order].T >= 0.9
    assert (links.counts()[0] == every.sum(1) - 1).all()
    assert len(set(links.label.tolist())) == 16
    assert sum(seen) < (every.sum() - 4000) / 20


def test_two_trees(spark):
    a, b = (ct.unit([np.array(v, "<f8").tobytes() for _, v in clustered(400, 6, s)], "<f8", 6) for s in (1, 1))
    b = b[:150]
    trees = []
    for x in (a, b):
        order, nodes, radius = ct.build(x)
        trees.append(ct.CoverTree(x[order], np.arange(1, len(x) + 1), nodes.astype(np.int64), radius))
    found_ = ct.dual_traversal(*trees, same=False)
    every = trees[0].points @ trees[1].points.T >= 0.9
    left, right = found_.counts()
    assert (left == every @ trees[1].weight).all() and (right == trees[0].weight @ every).all()
