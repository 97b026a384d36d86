"""Exact threshold join of embeddings by cosine with cover trees.

On unit vectors a cosine of at least ``MIN_COSINE`` is a Euclidean distance of at
most ``REACH``.

1. *Classes.*  Equal vectors are one class with a count, so copies meet as one.
2. *Cells.*  The upper levels of the tree come from a bounded sample (at most
   ``SAMPLE`` classes and ``SAMPLE_BYTES``, by smallest hash): nested levels with
   halving radii, each point a centre or within the radius of one.  Every class
   goes to its nearest centre; a cell knows its covering radius.  Two cells are
   compared only if their centres are no further apart than both radii and
   ``REACH``.  The sample only steers the cells: any choice gives the same links.
3. *Blocks.*  A cell is cut into blocks of about ``BLOCK`` classes by hash, so a hot
   cell is many blocks; each is built into a cover tree once and travels as one row.
4. *Dual traversal.*  A pair of blocks descends both trees together.  A pair of
   nodes is dropped when the distance of their centres, less both covering
   radii, exceeds ``REACH``, and linked as a whole when that distance plus both
   radii stays within it (nothing below is enumerated: each side's points gain
   the other's count).  The rest is split; pairs of small nodes are compared
   point by point.  Cosines within ``DOUBT`` of the threshold are computed anew
   with exact sums.
5. *Links.*  A pair of blocks returns a count per linked class and a spanning
   forest of its links, never the links themselves; components join the forests.

Where cells can be told apart the work falls far below all pairs of blocks; for
vectors spread evenly over many dimensions every cell is within reach of every
other, and an exact join compares all blocks.

Defined results: null or zero vectors and those with null or non-finite
components link with nothing, nor do vectors of different lengths with each
other; repeated rows are vectors of their own and linked; a null id is larger
than all others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.llm.components import components
from innsight.llm.util import written

MIN_COSINE = 0.9
REACH = math.sqrt(2 - 2 * MIN_COSINE)
DOUBT = 1e-9  # of a cosine
SLACK = 1e-6  # of a distance: more than the rounding of any
SAMPLE, SAMPLE_BYTES = 8192, 16 << 20
CELLS = 1024
BLOCK = 4096
LEAF = 16  # points
PARTNERS = 16  # blocks compared with one block in one group of rows


# ------------------------------------------------------------------ vectors
def _vectors(dtype: str):
    """Rows (id, vector) -> (id, name, dim, vector bytes), the last three null for vectors that cannot link."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            names, dims, raw = [], [], []
            column = b.column(1)
            values, ends = column.values, column.offsets.to_numpy()
            nulls = values.is_null().to_numpy(zero_copy_only=False)
            values = values.fill_null(0).to_numpy(zero_copy_only=False).astype(dtype) + 0  # -0.0 becomes 0.0
            fine = np.concatenate([[0], np.cumsum(~np.isfinite(values) | nulls)])
            for ok, lo, hi in zip(column.is_valid().to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                v = values[lo:hi]
                if ok and fine[lo] == fine[hi] and v.any():
                    raw.append(v.tobytes())
                    names.append(hashlib.blake2b(raw[-1], digest_size=16).digest())
                    dims.append(hi - lo)
                else:
                    for c in (raw, names, dims):
                        c.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.binary()), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())],
                                             ["id", "name", "dim", "vector"])

    return run


def unit(raw: list[bytes], dtype: str, dim: int) -> np.ndarray:
    """Vectors in double precision, scaled to length 1."""
    x = np.frombuffer(b"".join(raw), dtype).reshape(len(raw), dim).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two vectors reach the threshold, by correctly rounded sums."""
    dot, a, b = (math.fsum(p) for p in (x * y, x * x, y * y))
    return dot / (math.sqrt(a) * math.sqrt(b)) >= MIN_COSINE


# ------------------------------------------------------------------ cover tree
class CoverTree:
    """Points in tree order; node ``i`` covers points ``start[i]`` to ``end[i]``, the first of them its centre.

    Children are nodes ``kid[i]`` to ``kid_end[i]``; the first has the parent's centre.
    """

    def __init__(self, points: np.ndarray, weight: np.ndarray, nodes: np.ndarray, radius: np.ndarray):
        self.points, self.weight = points, weight
        self.start, self.end, self.kid, self.kid_end = nodes
        self.radius = radius
        self.total = np.concatenate([[0], np.cumsum(weight)])
        self.node_weight = self.total[self.end] - self.total[self.start]


def cover(points: np.ndarray, radius: float, at: np.ndarray) -> list[np.ndarray]:
    """Groups of the indices ``at``, each within ``radius`` of its first; the first group has the first index as its centre."""
    inner = 1 - radius * radius / 2
    out = []
    while len(at):
        near = points[at] @ points[at[0]] >= inner
        near[0] = True
        out.append(at[near])
        at = at[~near]
    return out


def build(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the points, nodes, radii) of a cover tree: a node's children have the largest half of 2, 1, 1/2, ... below its covering radius."""
    order = np.arange(len(points))
    start, end, kid, kid_end, radius = [0], [len(points)], [0], [0], []
    node = 0
    while node < len(start):
        lo, hi = start[node], end[node]
        at = order[lo:hi]
        centre = points[at[0]]
        far = math.sqrt(max(0.0, ((points[at] - centre) ** 2).sum(axis=1).max())) if hi - lo > 1 else 0.0
        radius.append(far)
        if hi - lo > LEAF and far > SLACK:
            groups = cover(points, 2.0 ** (math.ceil(math.log2(far)) - 1), at)
            order[lo:hi] = np.concatenate(groups)
            kid[node], kid_end[node] = len(start), len(start) + len(groups)
            for g in groups:
                start.append(lo)
                end.append(lo + len(g))
                kid.append(0)
                kid_end.append(0)
                lo += len(g)
        node += 1
    return order, np.array([start, end, kid, kid_end], np.int32), np.array(radius)


# ------------------------------------------------------------------ dual traversal
class Links:
    """What two trees link: counts per point, and a label per point shared by linked points."""

    def __init__(self, a: CoverTree, b: CoverTree, same: bool):
        self.a, self.b, self.same = a, b, same
        self.shift = 0 if same else len(a.points)
        self.label = np.arange(len(a.points) + (0 if same else len(b.points)))
        self.gain = [np.zeros(len(a.points) + 1, np.int64), np.zeros(len(b.points) + 1, np.int64)]  # points
        self.range_gain = [np.zeros(len(a.points) + 1, np.int64), np.zeros(len(b.points) + 1, np.int64)]  # steps of ranges
        self._edges, self._n = [], 0

    def points(self, p: np.ndarray, q: np.ndarray) -> None:
        if len(p):
            np.add.at(self.gain[0], p, self.b.weight[q])
            np.add.at(self.gain[1], q, self.a.weight[p])
            self._join(p, q + self.shift)

    def nodes(self, x: np.ndarray, y: np.ndarray) -> None:
        """All points of the nodes ``x`` with all of the nodes ``y``, pair by pair."""
        a, b = self.a, self.b
        for gain, t, u, other, v in ((self.range_gain[0], a, x, b, y), (self.range_gain[1], b, y, a, x)):
            np.add.at(gain, t.start[u], other.node_weight[v])
            np.add.at(gain, t.end[u], -other.node_weight[v])
        for u, v in zip(x.tolist(), y.tolist()):
            p, q = np.arange(a.start[u], a.end[u]), np.arange(b.start[v], b.end[v]) + self.shift
            self._join(p, np.full(len(p), q[0]))
            self._join(q, np.full(len(q), p[0]))

    def _join(self, u: np.ndarray, v: np.ndarray) -> None:
        self._edges.append((u, v))
        self._n += len(u)
        if self._n > 1_000_000:
            self.fold()

    def fold(self) -> None:
        """Join the labels of all edges seen."""
        if not self._edges:
            return
        u, v = (np.concatenate(e) for e in zip(*self._edges))
        label = self.label
        while True:
            lu, lv = label[u], label[v]
            if (lu == lv).all():
                break
            low = np.minimum(lu, lv)
            np.minimum.at(label, lu, low)
            np.minimum.at(label, lv, low)
            while (label[label] != label).any():
                label = label[label]
        self.label, self._edges, self._n = label, [], 0

    def counts(self) -> list[np.ndarray]:
        a, b = (g[:-1] + np.cumsum(r)[:-1] for g, r in zip(self.gain, self.range_gain))
        return [a + b] if self.same else [a, b]


def _points(t: CoverTree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All points of the nodes, and the place in ``nodes`` of the node that each belongs to."""
    n = t.end[nodes] - t.start[nodes]
    place = np.repeat(np.arange(len(nodes)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + t.start[nodes][place], place


def dual_traversal(a: CoverTree, b: CoverTree, same: bool) -> Links:
    """The links between the points of ``a`` and ``b`` (``same``: within ``a``, which ``b`` is)."""
    out = Links(a, b, same)
    todo = [(0, 0)]

    def compare(x: np.ndarray, y: np.ndarray, triangle: bool = False, open_: np.ndarray | None = None, of_x=None, of_y=None) -> None:
        """Points x with points y; with ``open_``, only where it holds for the nodes they are of."""
        for lo in range(0, len(x), 512):
            c = a.points[x[lo:lo + 512]] @ b.points[y].T
            near = c >= MIN_COSINE - DOUBT
            if triangle:
                near &= np.arange(lo, lo + len(c))[:, None] < np.arange(len(y))[None]
            i, j = np.nonzero(near)
            ok = c[i, j] >= MIN_COSINE
            for k in np.flatnonzero(np.abs(c[i, j] - MIN_COSINE) <= DOUBT):
                ok[k] = _linked(a.points[x[i[k] + lo]], b.points[y[j[k]]])
            if open_ is not None:
                ok &= open_[of_x[i + lo], of_y[j]]
            out.points(x[i[ok] + lo], y[j[ok]])

    def split(u: np.ndarray, v: np.ndarray, triangle: bool) -> None:
        """Nodes u with nodes v: dropped, linked as a whole, compared by points (leaves) or left to be split."""
        for lo in range(0, len(u), 512):
            p = u[lo:lo + 512]
            c = a.points[a.start[p]] @ b.points[b.start[v]].T
            d = np.sqrt(np.maximum(0.0, 2 - 2 * c))
            r = a.radius[p][:, None] + b.radius[v][None]
            open_ = d - r <= REACH + SLACK
            if triangle:
                open_ &= p[:, None] < v[None]
            whole = open_ & (d + r <= REACH - SLACK)
            i, j = np.nonzero(whole)
            if len(i):
                out.nodes(p[i], v[j])
            open_ &= ~whole
            leaves = (a.kid[p] == a.kid_end[p])[:, None] & (b.kid[v] == b.kid_end[v])[None]
            i, j = np.nonzero(open_ & ~leaves)
            todo.extend(zip(p[i].tolist(), v[j].tolist()))
            open_ &= leaves
            i, j = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
            if len(i):
                x, of_x = _points(a, p[i])
                y, of_y = _points(b, v[j])
                compare(x, y, False, open_[np.ix_(i, j)], of_x, of_y)

    while todo:
        i, j = todo.pop()
        diagonal = same and i == j
        na, nb = int(a.end[i] - a.start[i]), int(b.end[j] - b.start[j])
        inner_a, inner_b = a.kid[i] < a.kid_end[i], b.kid[j] < b.kid_end[j]
        if na * nb <= 4096 or not (inner_a or inner_b):
            compare(np.arange(a.start[i], a.end[i]), np.arange(b.start[j], b.end[j]), diagonal)
            continue
        x = np.arange(a.kid[i], a.kid_end[i]) if inner_a and (diagonal or not inner_b or 4 * na >= nb) else np.array([i])
        y = np.arange(b.kid[j], b.kid_end[j]) if inner_b and (diagonal or not inner_a or 4 * nb >= na) else np.array([j])
        one_x, one_y = a.end[x] - a.start[x] == 1, b.end[y] - b.start[y] == 1
        compare(a.start[x[one_x]], b.start[y[one_y]], diagonal)  # single points need no bounds
        if diagonal:
            todo += [(k, k) for k in x[~one_x].tolist()]
            split(x[~one_x], y[~one_y], True)
            split(x[~one_x], y[one_y], False)
        else:
            split(x[~one_x], y, False)
            split(x[one_x], y[~one_y], False)
    out.fold()
    return out


# ------------------------------------------------------------------ blocks and their pairs
def _blocks(dtype: str):
    """Rows (dim, cell, chunk, name, n, vector) in order of the first three -> a row per block with its tree."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def block(key, rows):
            names, n, raw = zip(*rows)
            order, nodes, radius = build(unit(list(raw), dtype, key[0]))
            return pa.RecordBatch.from_arrays(
                [*[pa.array([k], t) for k, t in zip(key, (pa.int32(), pa.int32(), pa.int32()))],
                 *[pa.array([v], pa.binary()) for v in (b"".join(names[k] for k in order), b"".join(raw[k] for k in order),
                                                       np.array(n, np.int64)[order].tobytes(), nodes.tobytes(), radius.tobytes())]],
                ["dim", "cell", "chunk", "names", "vectors", "weights", "nodes", "radii"])

        key, rows = None, []
        for b in batches:
            for dim, cell, chunk, name, n, vector in zip(*(c.to_pylist() for c in b.columns)):
                if (dim, cell, chunk) != key:
                    if rows:
                        yield block(key, rows)
                    key, rows = (dim, cell, chunk), []
                rows.append((name, n, vector))
        if rows:
            yield block(key, rows)

    return run


def _tree(dtype: str, dim: int, names: bytes, vectors: bytes, weights: bytes, nodes: bytes, radii: bytes) -> tuple[list[bytes], CoverTree]:
    width = dim * np.dtype(dtype).itemsize
    points = unit([vectors[i:i + width] for i in range(0, len(vectors), width)], dtype, dim)
    tree = CoverTree(points, np.frombuffer(weights, np.int64), np.frombuffer(nodes, np.int32).reshape(4, -1).astype(np.int64), np.frombuffer(radii))
    return [names[i:i + 16] for i in range(0, len(names), 16)], tree


def _meet(dtype: str):
    """Rows (group, room, is_partner, dim, block's tree), a block first and its partners after it -> counts and forest edges."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = own_names = None
        for b in batches:
            for k in range(b.num_rows):
                partner, dim, *packed = (b.column(c)[k].as_py() for c in range(2, b.num_columns))
                if not partner:
                    own, own_names = _tree(dtype, dim, *packed), packed[0]
                    continue
                same = packed[0] == own_names
                other = own if same else _tree(dtype, dim, *packed)
                found, sides = dual_traversal(own[1], other[1], same), [own] if same else [own, other]
                names = [x for s in sides for x in s[0]]
                gain = np.concatenate(found.counts())
                counted, joined = np.flatnonzero(gain), np.flatnonzero(found.label != np.arange(len(names)))
                if len(counted):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[i] for i in counted] + [names[i] for i in joined], pa.binary()),
                         pa.array([None] * len(counted) + [names[i] for i in found.label[joined]], pa.binary()),
                         pa.array(np.concatenate([gain[counted], np.zeros(len(joined), np.int64)]))], ["a", "b", "n"])

    return run


def _centres(sample: list[bytes], dtype: str, dim: int, wanted: int) -> np.ndarray:
    """Up to ``wanted`` centres of the upper levels of a cover tree over the sample, coarse levels first."""
    points = unit(sample, dtype, dim)
    out: list[int] = [0]
    groups, radius = [np.arange(len(points))], 1.0
    while len(out) < wanted and any(len(g) > 1 for g in groups) and radius > SLACK:
        groups = [h for g in groups for h in cover(points, radius, g)]
        seen = set(out)
        out += [c for c in (int(g[0]) for g in groups) if c not in seen]
        radius /= 2
    return points[out[:wanted]]


def _cells(dtype: str, dim: int, centres):
    """Rows (dim, name, n, vector) with their cell and the distance to its centre; vectors of other lengths have one cell."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            dims = b.column(0).to_numpy()
            cell, far = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            at = np.flatnonzero(dims == dim)
            raw = b.column(3)
            for lo in range(0, len(at), 4096):
                some = at[lo:lo + 4096]
                c = unit([raw[int(i)].as_py() for i in some], dtype, dim) @ centres.value.T
                cell[some] = c.argmax(axis=1)
                far[some] = np.sqrt(np.maximum(0.0, 2 - 2 * c.max(axis=1)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], ["dim", "name", "n", "vector", "cell", "far"])

    return run


def _block_table(classes: DataFrame, dtype: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of the classes (dim, name, n, vector) with their trees, and the pairs of cells (dim, cell, other) within reach."""
    spark = classes.sparkSession
    item = np.dtype(dtype).itemsize
    sizes = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    dim, n = (sizes["dim"], sizes["n"]) if sizes else (1, 0)
    rows = max(2, min(SAMPLE, SAMPLE_BYTES // (dim * 8)))
    sample = [r[0] for r in classes.where(F.col("dim") == dim).orderBy("name").limit(rows).select("vector").collect()]
    wanted = min(CELLS, -(-n // BLOCK))
    middle = _centres(sample, dtype, dim, wanted) if wanted > 1 else np.eye(1, dim)
    centres = spark.sparkContext.broadcast(middle)
    schema = "dim int, name binary, n long, vector binary, cell int, far double"
    placed = written(classes.select("dim", "name", "n", "vector").mapInArrow(_cells(dtype, dim, centres), schema), "cells")
    # One row a cell for the common length, one a length otherwise.
    known = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("classes"), F.max("far").alias("radius"))
    known = written(known, "cell_sizes")
    own = {r["cell"]: r["radius"] for r in known.where(F.col("dim") == dim).collect()}  # CELLS at most
    centres.destroy()
    cells = np.array(sorted(own), np.int64)
    radius = np.array([own[c] for c in cells.tolist()])
    far = np.sqrt(np.maximum(0.0, 2 - 2 * middle[cells] @ middle[cells].T)) if len(cells) else np.zeros((0, 0))
    i, j = np.nonzero(np.triu(far - radius[:, None] - radius[None] <= REACH + SLACK)) if wanted > 1 else (np.arange(len(cells)),) * 2
    near = spark.createDataFrame([(dim, int(cells[x]), int(cells[y])) for x, y in zip(i, j)], "dim int, cell int, other int")
    near = near.unionAll(known.where(F.col("dim") != dim).select("dim", "cell", F.col("cell").alias("other")))
    chunk = F.pmod(F.xxhash64("name"), F.ceil(F.col("classes") / BLOCK)).cast("int")
    dealt = placed.join(known.select("dim", "cell", "classes"), ["dim", "cell"]).select("dim", "cell", chunk.alias("chunk"), "name", "n", "vector")
    dealt = dealt.repartition("dim", "cell", "chunk").sortWithinPartitions("dim", "cell", "chunk", "name")
    block = "dim int, cell int, chunk int, names binary, vectors binary, weights binary, nodes binary, radii binary"
    return written(dealt.mapInArrow(_blocks(dtype), block), "blocks"), near


def _block_links(blocks: DataFrame, near: DataFrame, dtype: str) -> DataFrame:
    """Counts (a, null, n) and forest edges (a, b, 0) of all pairs of blocks within reach."""
    name = F.concat_ws(":", "dim", "cell", "chunk")
    index = blocks.select("dim", "cell", name.alias("block"))
    one = index.join(near, ["dim", "cell"]).select("dim", "cell", "other", F.col("block").alias("a"))
    two = index.select(F.col("dim").alias("_d"), F.col("cell").alias("_c"), F.col("block").alias("b"))
    pairs = one.join(two, (F.col("dim") == F.col("_d")) & (F.col("other") == F.col("_c"))).where((F.col("cell") != F.col("other")) | (F.col("a") <= F.col("b")))
    turn = F.pmod(F.xxhash64(F.least("a", "b"), F.greatest("a", "b")), F.lit(2)) == 0  # either block may be the one that waits
    pairs = written(pairs.select(F.when(turn, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(turn, F.col("b")).otherwise(F.col("a")).alias("b")), "block_pairs")
    rooms = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("rooms"))
    pairs = pairs.join(rooms, "a").withColumn("room", F.pmod(F.xxhash64("b"), F.col("rooms")))
    tree = ["dim", "names", "vectors", "weights", "nodes", "radii"]
    sent = blocks.withColumn("_block", name)
    partners = pairs.join(sent, F.col("b") == F.col("_block")).select("a", "room", F.lit(True).alias("partner"), *tree)
    waiting = pairs.select("a", "room").distinct().join(sent, F.col("a") == F.col("_block")).select("a", "room", F.lit(False).alias("partner"), *tree)
    met = waiting.unionAll(partners).repartition("a", "room").sortWithinPartitions("a", "room", "partner")
    return met.mapInArrow(_meet(dtype), "a binary, b binary, n long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: ``id_col``, n_links, component_id, kept, class_id (equal vectors share it; null: links with nothing)."""
    element = vectors.schema[vector_col].dataType.elementType
    dtype = "<f4" if isinstance(element, T.FloatType) else "<f8"
    source = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<float>" if dtype == "<f4" else "array<double>").alias("v"))
    schema = T.StructType([source.schema["id"], T.StructField("name", T.BinaryType()), T.StructField("dim", T.IntegerType()), T.StructField("vector", T.BinaryType())])
    rows = written(source.mapInArrow(_vectors(dtype), schema), "vectors")
    classes = rows.where("name IS NOT NULL").groupBy("name").agg(
        F.first("dim").alias("dim"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    classes = written(classes, "classes")
    found = written(_block_links(*_block_table(classes, dtype), dtype), "links")
    counts = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("links"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    named = classes.select("name", "n", "least").join(counts, F.col("name") == F.col("a"), "left").join(roots, F.col("name") == F.col("node"), "left")
    named = written(named.select("name", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "least", F.coalesce("root", "name").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select(F.col("name").alias("_name"), "n_links", "component_id")
    out = rows.select("id", "name").join(named, F.col("name") == F.col("_name"), "left")
    group = F.when(F.col("_name").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), group.alias("component_id"),
                      F.col("id").eqNullSafe(group).alias("kept"), F.col("name").alias("class_id"))
