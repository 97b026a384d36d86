"""Exact Jaccard join of word shingle sets with signature trees.

Documents become sets of hashed five-word shingles; equal sets are one class
(named by a 64-bit hash of the set).  Classes with a Jaccard similarity of 80 %
or more are linked, and linked documents share a component.

1. *Blocks.*  Under one global order of shingles, two linked sets share a
   shingle among the first ``n - ceil(0.8 n) + 1`` of each, and of the smaller
   set among the first ``n - ceil(8 n / 9) + 1`` (it is *early* there).  Those
   shingles are the block keys of a class, so no link is lost.  The order puts frequent
   shingles last (by the logarithm of a partial count over all documents, then
   by hash): a passage that a third of all documents share hardly ever makes a
   block.  The counts only steer the order.
2. *Stars.*  Each block names one of its classes, by a hash of block and class,
   its centre; a class and its centres are candidates, unless their bitmaps rule
   a link out.  Two of them, picked by hash, are verified for each class, so a
   group of thousands of near copies is connected by two links a copy, never by
   all of its pairs.  Stars that then still connect different components are
   verified with the next step's pairs: blocks of two classes have no others.
3. *Signature trees.*  Larger blocks that still hold several components (any two of
   which may hold a link yet) are searched completely: first by narrow bitmaps, which
   only say which classes have a candidate there at all, then those classes by wide
   ones.  The classes of a block,
   ordered by size, become the leaves of a tree whose nodes hold the OR of their
   token bitmaps and their range of sizes.  A dual traversal descends into a
   pair of nodes only if the largest overlap that bitmaps and sizes allow
   reaches 80 %, and if they are not of one component; of the blocks that two
   classes share, the one with the smallest key gives their pair (blocks of at most
   ``LEAF`` classes, one leaf each, may repeat it).  Blocks of more than ``CHUNK`` classes are cut into chunks whose pairs are separate rows.
4. *Rounds.*  ``FOREST_ROUNDS`` searches hand on only a spanning forest of each
   block's candidates, fewer than its classes, so a family of copies is joined
   without its pairs.  A block whose forest holds all its candidates is finished;
   the others are searched again, and a last search hands on every candidate
   between the components that are left, so no link is lost.

Every candidate is verified exactly on the sets.  Postings travel as arrays per
(batch, key range); memory of a task is bounded by the key ranges, whose number
grows with the shingle count.

Defined results: a text of fewer than five words is one shingle, its whole word
sequence; null texts and texts without words have the empty set and are linked
with nothing; rows that share an id and differ in text are rows of their own,
linked to the smallest id reachable; null ids count as larger than all others
(a component of null ids alone has a null component id); empty tables give
empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.llm.components import components
from innsight.llm.util import batches_of_bytes, concat_text, mix, release_memory, shingle_rows, written

WORDS = 5
FREQUENT_SHARE = 0.0005  # of all documents: the least count that moves a shingle back in the order
MAX_FREQUENT = 500_000  # of the counted shingles, the most frequent: a bound on what is broadcast
RANGE_POSTINGS = 500_000
CHUNK = 2048
LEAF = 32
NARROW_BITS, WIDE_BITS = 1, 8  # bits a shingle of the bitmaps, at least
FOREST_ROUNDS = 2
COMPARED_BYTES = 16 << 20  # of bitmaps held at once
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20


def _sets(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of each shingle, shingle, first shingle of each row, set size, class) of a batch with the text last."""
    data, offsets = concat_text(batch.column(batch.num_columns - 1))
    row, shingle = shingle_rows(data, offsets, WORDS)
    size = np.bincount(row, minlength=batch.num_rows).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shingle))])
    name = mix(total[first[1:]] - total[first[:-1]] + size.astype(np.uint64)).view(np.int64)
    return row, shingle, first[:-1], size, name


def _describe(batches: Iterator) -> Iterator:
    """A row per document (id, class, size), and a row per batch with its frequent shingles."""
    import pyarrow as pa

    for b in batches_of_bytes(batches, "_text"):
        _, shingle, _, size, name = _sets(b)
        token, count = np.unique(shingle, return_counts=True)
        often = count >= max(4, b.num_rows // 200)
        n = b.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([b.column(0), pa.nulls(1, b.column(0).type)]), pa.array(np.append(name, 0)), pa.array(np.append(size, -1)),
             pa.array([None] * n + [token[often].view(np.int64)], pa.list_(pa.int64())), pa.array([None] * n + [count[often]], pa.list_(pa.int64()))],
            ["_id", "class", "size", "tokens", "counts"])


def _postings(ranges: int, order):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        frequent, level = order.value
        for b in batches_of_bytes(batches, "_text"):
            row, shingle, first, size, name = _sets(b)
            if not len(shingle):
                continue
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, shingle), len(frequent) - 1)
                late = np.where(frequent[at] == shingle, level[at], 0)
                shingle = shingle[np.lexsort((shingle, late, row))]
            place = np.arange(len(shingle)) - first[row]
            inside = place < (size - -(-size * 4 // 5) + 1)[row]
            early = (place < (size - -(-size * 8 // 9) + 1)[row])[inside]
            row, shingle = row[inside], shingle[inside]
            key, cls = shingle.view(np.int64), name[row]
            part = (shingle % np.uint64(ranges)).astype(np.int64)
            by = np.lexsort((cls, key, part))
            key, cls, part, n = key[by], cls[by], part[by], np.where(early, size[row], -size[row])[by]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
            key, cls, part, n = key[new], cls[new], part[new], n[new]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
            lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(v)) for v in (key, cls, n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]]), *lists], ["part", "keys", "classes", "sizes"])

    return run


def _blocks(batches: Iterator) -> Iterator:
    """Keys that several classes share: one row per block.

    A negative size marks a class whose key is not early.  It only concerns
    early ones that are no larger and within 80 % of its size; without any it
    leaves the block.
    """
    import pyarrow as pa

    keys, classes, sizes = [], [], []
    for b in batches:
        for into, i in ((keys, 1), (classes, 2), (sizes, 3)):
            into.append(b.column(i).flatten().to_numpy())
    if not keys:
        return
    key, cls, n = np.concatenate(keys), np.concatenate(classes), np.concatenate(sizes)
    del keys, classes, sizes
    by = np.lexsort((cls, key))
    key, cls, n = key[by], cls[by], n[by]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
    key, cls, n = key[new], cls[new], n[new]
    start = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
    length = np.diff(np.append(start, len(key)))
    least = np.repeat(np.minimum.reduceat(np.where(n > 0, n, 1 << 30), start), length)
    most = np.repeat(np.maximum.reduceat(n, start), length)
    stays = (n > 0) | (-n >= least) & (-n.astype(np.int64) * 4 <= 5 * most.astype(np.int64))
    key, cls, n = key[stays], cls[stays], n[stays]
    if not len(key):
        return
    start = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
    length = np.diff(np.append(start, len(key)))
    shared = np.repeat(length > 1, length)
    start, length = start[length > 1], length[length > 1]
    key, cls, n = key[shared], cls[shared], n[shared]
    at = np.concatenate([[0], np.cumsum(length)])
    centre_of = _centres(key, cls, at)
    for lo in range(0, len(length), 20_000):
        hi = min(len(length), lo + 20_000)
        cut = pa.array(at[lo:hi + 1] - at[lo], pa.int32())
        span = slice(at[lo], at[hi])
        lists = [pa.ListArray.from_arrays(cut, pa.array(v[span])) for v in (cls, n)]
        yield pa.RecordBatch.from_arrays([pa.array(key[at[lo:hi]]), pa.array(cls[centre_of[lo:hi]]), pa.array(n[centre_of[lo:hi]]), *lists],
                                         ["key", "centre", "centre_size", "classes", "sizes"])
    del key, cls, n, stays, shared, start, length, least, most, by, new, at, centre_of
    release_memory()


def _centres(key: np.ndarray, cls: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Index of each block's centre: the class with the smallest hash, so that blocks of the same classes agree on few centres."""
    if not len(key):
        return np.zeros(0, np.int64)
    h = mix(cls.view(np.uint64))
    block = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return np.lexsort((h, block))[at[:-1]]


def _width(n: int, density: int = WIDE_BITS) -> int:
    """Bits of the bitmap of a set of ``n`` shingles: a power of two, one to two times ``density`` a shingle, 64 at least."""
    return max(64, density << int(n - 1).bit_length())


def _bitmap(shingle: np.ndarray, density: int = WIDE_BITS) -> bytes:
    bits = np.zeros(_width(len(shingle), density), bool)
    bits[(shingle % np.uint64(len(bits))).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _add_narrow(batches: Iterator) -> Iterator:
    """Rows (class, size, wide bitmap) with the narrow bitmap: the wide one folded."""
    import pyarrow as pa

    for b in batches:
        narrow = [_fold(np.frombuffer(wide, np.uint8)[None], _width(n, NARROW_BITS) // 8).tobytes() for n, wide in zip(b.column(1).to_pylist(), (x.as_py() for x in b.column(2)))]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(narrow, pa.binary())], ["class", "size", "wide", "narrow"])


def _contents(density: int):
    """Rows (class, where it is needed, text) -> (class, size, bitmap of ``density`` bits a shingle or, at 0, the shingles, where)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches_of_bytes(batches, "_text", 2 << 20):
            _, shingle, first, size, name = _sets(b)
            same = name == b.column(0).to_numpy()  # other rows of the same id may have come along
            spans = list(zip(first[same].tolist(), size[same].tolist()))
            if density:
                content = pa.array([_bitmap(shingle[f:f + n], density) for f, n in spans], pa.binary())
            else:
                content = pa.array([shingle[f:f + n].tobytes() for f, n in spans], pa.binary())
            keep = pa.array(same)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), pa.array(size[same]), content, b.column(1).filter(keep)], ["class", "size", "content", "at"])

    return run


def _signatures(batches: Iterator) -> Iterator:
    """Rows (class, where it is needed, text) -> (class, size, wide bitmap, narrow bitmap), in one function: two would take two workers a task."""
    return _add_narrow(b.select(["class", "size", "content"]) for b in _contents(WIDE_BITS)(batches))


def _meet(bitmaps: bool):
    """Members against the centre of their meeting (rows sorted by meeting, the centre first): the pairs that (may) link."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        centre = None
        for b in batches:
            members, centres = [], []
            for cls, meeting, n, cell in zip(*(c.to_pylist() for c in b.columns[:3]), b.column(3)):
                content = cell.as_py()
                if cls == meeting:
                    centre = (cls, n, content, None if bitmaps else np.frombuffer(content, np.uint64))
                elif centre is not None and centre[0] == meeting:
                    if bitmaps:
                        x, y = (np.frombuffer(c, np.uint8)[None] for c in (content, centre[2]))
                        width = min(x.shape[1], y.shape[1])
                        x, y = _fold(x, width).copy().view(np.uint64), _fold(y, width).copy().view(np.uint64)
                        ok = _may_link(_count(x & y), n - _count(x), centre[1] - _count(y), n, centre[1], n, centre[1])[0]
                    else:
                        common = len(np.intersect1d(np.frombuffer(content, np.uint64), centre[3], assume_unique=True))
                        ok = 100 * common >= 80 * (n + centre[1] - common)
                    if ok:
                        members.append(cls)
                        centres.append(meeting)
            if members:
                yield pa.RecordBatch.from_arrays([pa.array(members, pa.int64()), pa.array(centres, pa.int64())], ["a", "b"])
        release_memory()

    return run


# ------------------------------------------------------------------ signature trees
class SignatureTree:
    """Sets ordered by size; node ``i`` of a level covers nodes ``2i`` and ``2i + 1`` of the level below."""

    def __init__(self, size: np.ndarray, bits: np.ndarray, root: np.ndarray):
        order = np.lexsort((bits[:, 0], root, size))
        self.order, self.size, self.bits, self.root = order, size[order], bits[order], root[order]
        self.slack = self.size - _count(self.bits)  # shingles that share a bit with another of their set
        edge = np.arange(0, len(size), LEAF)
        self.levels = [(np.bitwise_or.reduceat(self.bits, edge), np.minimum.reduceat(self.size, edge), np.maximum.reduceat(self.size, edge),
                        np.maximum.reduceat(self.slack, edge), *self._one_root(edge))]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, slack, first, last = self.levels[-1]
            edge = np.arange(0, len(bits), 2)
            self.levels.append((np.bitwise_or.reduceat(bits, edge), np.minimum.reduceat(low, edge), np.maximum.reduceat(high, edge),
                                np.maximum.reduceat(slack, edge), np.minimum.reduceat(first, edge), np.maximum.reduceat(last, edge)))

    def _one_root(self, edge):
        return np.minimum.reduceat(self.root, edge), np.maximum.reduceat(self.root, edge)


def _count(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(-1).astype(np.int64)


def _may_link(common, slack_a, slack_b, low_a, low_b, high_a, high_b):
    """Whether sets in these ranges can reach 80 %: by common bits plus shingles hidden behind shared bits, and by size."""
    most = np.minimum(common + np.minimum(slack_a, slack_b), np.minimum(high_a, high_b))
    return (9 * most >= 4 * (low_a + low_b)) & (5 * high_a >= 4 * low_b) & (5 * high_b >= 4 * low_a)


def dual_traversal(a: SignatureTree, b: SignatureTree, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices (into the trees' input) of the pairs of different roots that may link."""
    top = max(len(a.levels), len(b.levels)) - 1
    some = max(1, COMPARED_BYTES // (8 * a.bits.shape[1]))
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(top, -1, -1):
        la, lb = a.levels[min(level, len(a.levels) - 1)], b.levels[min(level, len(b.levels) - 1)]
        ok = np.concatenate([
            _may_link(_count(la[0][x] & lb[0][y]), la[3][x], lb[3][y], la[1][x], lb[1][y], la[2][x], lb[2][y])
            & ~((la[4][x] == la[5][x]) & (lb[4][y] == lb[5][y]) & (la[4][x] == lb[4][y]))
            for x, y in ((i[k:k + some], j[k:k + some]) for k in range(0, len(i), some))]) if len(i) else np.zeros(0, bool)
        i, j = i[ok], j[ok]
        if level:
            split_a, split_b = level < len(a.levels), level < len(b.levels)
            na, nb = (len(t.levels[min(level - 1, len(t.levels) - 1)][0]) for t in (a, b))
            i, j = (np.concatenate([p.repeat(1) for p in q]) for q in zip(*[
                ((2 * i + da if split_a else i), (2 * j + db if split_b else j)) for da in ((0, 1) if split_a else (0,)) for db in ((0, 1) if split_b else (0,))]))
            inside = (i < na) & (j < nb) & ((i <= j) if same else True)
            i, j = i[inside], j[inside]
    out_a, out_b = [], []
    for x, y in zip(i.tolist(), j.tolist()):
        p, q = np.arange(x * LEAF, min(len(a.size), (x + 1) * LEAF)), np.arange(y * LEAF, min(len(b.size), (y + 1) * LEAF))
        some = max(1, COMPARED_BYTES // (8 * a.bits.shape[1] * len(q)))
        common = np.concatenate([_count(a.bits[p[k:k + some]][:, None] & b.bits[q][None]) for k in range(0, len(p), some)])
        ok = _may_link(common, a.slack[p][:, None], b.slack[q][None], a.size[p][:, None], b.size[q][None],
                       a.size[p][:, None], b.size[q][None]) & (a.root[p][:, None] != b.root[q][None])
        if same:
            ok &= p[:, None] < q[None]
        u, v = np.nonzero(ok)
        out_a.append(a.order[p[u]])
        out_b.append(b.order[q[v]])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def _fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Rows of packed bitmaps folded to ``width`` bytes (position modulo the width)."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def _meet_before(a: list[dict], b: list[dict], i: np.ndarray, j: np.ndarray, key: int) -> np.ndarray:
    """Which pairs (a[i], b[j]) also share a block of smaller key, where they are compared."""
    column: dict[int, int] = {}
    for x in (*a, *b):
        for k in x["keys"]:
            if k < key:
                column.setdefault(k, len(column))
    packed = []
    for rows in (a, b):
        bits = np.zeros((len(rows), max(1, len(column))), bool)
        for r, x in enumerate(rows):
            bits[r, [column[k] for k in x["keys"] if k < key]] = True
        packed.append(np.packbits(bits, axis=1))
    return np.concatenate([np.zeros(0, bool)] + [(packed[0][i[n:n + 65536]] & packed[1][j[n:n + 65536]]).any(1) for n in range(0, len(i), 65536)])


def _matches(left, right=None) -> Iterator[tuple[list, list, np.ndarray, np.ndarray]]:
    """Rows ``a`` and ``b`` of a bitmap width each and the indices of their pairs that may link, by the trees of both."""
    groups = []
    for side in (left,) if right is None else (left, right):
        by: dict[int, list] = {}
        for x in side:
            by.setdefault(len(x["bitmap"]), []).append(x)
        groups.append(by)
    a, b = groups[0], groups[-1]
    for wa in sorted(a):
        for wb in (wa, 2 * wa) if right is None else (wa // 2, wa, 2 * wa):  # 80 % leaves at most one power of two between
            if wb not in b:
                continue
            width = min(wa, wb)
            trees = []
            for rows in (a[wa], b[wb]):
                bits = _fold(np.frombuffer(b"".join(x["bitmap"] for x in rows), np.uint8).reshape(len(rows), -1), width).copy().view(np.uint64)
                trees.append(SignatureTree(np.array([x["size"] for x in rows], np.int64), bits, np.array([x["root"] for x in rows], np.int64)))
            yield a[wa], b[wb], *dual_traversal(*trees, same=right is None and wa == wb)


def tree_candidates(left, right=None, key: int | None = None) -> list[tuple[int, int]]:
    """Pairs of classes that may link, within ``left`` or between ``left`` and ``right`` (class, size, root, bitmap each).

    ``key``, the block's own, leaves out pairs that share a block of smaller key (``keys`` of each class).
    """
    found: list[tuple[int, int]] = []
    for a, b, i, j in _matches(left, right):
        if key is not None:
            alone = ~_meet_before(a, b, i, j, key)
            i, j = i[alone], j[alone]
        found += [(a[x]["class"], b[y]["class"]) for x, y in zip(i.tolist(), j.tolist())]
    return found


def _with_candidates(batches: Iterator) -> Iterator:
    """(key, classes): the classes of a block, or of two of its chunks, that have any candidate there."""
    import pyarrow as pa

    for batch in batches:
        keys, classes = [], []
        for key, left, right in zip(*batch.columns):
            some: set[int] = set()
            for a, b, i, j in _matches(left.as_py(), right.as_py()):
                some.update(a[x]["class"] for x in np.unique(i).tolist())
                some.update(b[y]["class"] for y in np.unique(j).tolist())
            if some:
                keys.append(key.as_py())
                classes.append(sorted(some))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(classes, pa.list_(pa.int64()))], ["key", "classes"])
    release_memory()


def spanning(pairs: list[tuple[int, int]], root: dict[int, int]) -> list[tuple[int, int]]:
    """A forest of the pairs: they join the same components as all of them, if all of them link."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    out = []
    for a, b in pairs:
        p, q = top(root[a]), top(root[b])
        if p != q:
            up[p] = q
            out.append((a, b))
    return out


def _search(forest: int | None):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = set()
            for block, large, left, right in zip(*b.columns):
                block, left, right = block.as_py(), left.as_py(), right.as_py()
                found = [(min(p), max(p)) for p in tree_candidates(left, right, block if large.as_py() else None)]
                if forest is not None:
                    odd = 0x9E3779B97F4A7C15 + 2 * forest  # blocks that share pairs prefer the same ones
                    some = spanning(sorted(found, key=lambda p: ((p[0] ^ p[1] * odd) * odd >> 20) % (1 << 61)), {x["class"]: x["root"] for x in (*left, *(right or ()))})
                    if len(some) < len(found):
                        rows.add((0, 0, block))
                    found = some
                rows.update((*p, None) for p in found)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["a", "b", "unfinished"])
        release_memory()

    return run


# ------------------------------------------------------------------ the join
def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, n_shingles, component_id, class_id, spanning_links (verified links of its class)."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([T.StructField("_id", source.schema["_id"].dataType), T.StructField("class", T.LongType()), T.StructField("size", T.LongType()),
                           T.StructField("tokens", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType()))])
    described = written(source.mapInArrow(_describe, schema), "sets")
    rows = described.where("size >= 0").select("_id", "class", "size")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")).first()
    frequent = described.where("size < 0").select(F.explode(F.arrays_zip("tokens", "counts")).alias("t")).groupBy(F.col("t.tokens").alias("token")).agg(F.sum("t.counts").alias("n"))
    often = frequent.where(F.col("n") >= max(8, total["n"] * FREQUENT_SHARE)).orderBy(F.desc("n"), "token").limit(MAX_FREQUENT).toArrow()
    token = often.column("token").to_numpy().view(np.uint64)
    by = np.argsort(token)
    level = np.frexp(often.column("n").to_numpy().astype(float))[1]
    order = spark.sparkContext.broadcast((token[by], level[by].astype(np.int64)))

    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total["s"] or 0) // (5 * RANGE_POSTINGS)))
    sent = source.select("_text").mapInArrow(_postings(ranges, order), "part long, keys array<long>, classes array<long>, sizes array<int>")
    blocks = written(sent.repartition(ranges, "part").mapInArrow(_blocks, "key long, centre long, centre_size int, classes array<long>, sizes array<int>"), "blocks")

    # One document of each class that shares a block.
    shared = blocks.select(F.explode("classes").alias("class")).distinct()
    one = rows.where("size > 0").groupBy("class").agg(F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"))).alias("_one"))
    one = written(one.join(shared, "class").select("class", F.col("_one.i").alias("_one")), "shared")

    star = blocks.select("centre", "centre_size", F.explode(F.arrays_zip("classes", "sizes")).alias("o")).where("centre <> o.classes")
    star = star.where(_sizes_fit(F.col("centre_size"), F.col("o.sizes")) | _sizes_fit(F.col("o.sizes"), F.col("centre_size")))
    star = written(star.select(F.col("o.classes").alias("a"), F.col("centre").alias("b")).distinct(), "stars")
    star = written(_verified(source, one, star, bitmaps=True), "possible")
    h = F.xxhash64("a", "b")
    two = star.groupBy("a").agg(F.array(F.min_by("b", h), F.max_by("b", h)).alias("b")).select("a", F.explode(F.array_distinct("b")).alias("b"))
    links = written(_verified(source, one, two), "verified")
    roots = components(links)
    order.destroy()  # the blocks are written
    blocks = blocks.where(F.size("classes") > 2).select("key", F.explode("classes").alias("class"))  # two: the pair is a star, see _apart
    members = _open_members(blocks, roots)
    needed = members.select("class").distinct().withColumn("at", F.lit(0))
    signatures = written(_texts(source, one, needed).mapInArrow(_signatures, "class long, size long, wide binary, narrow binary"), "signatures")
    blocks = written(_tree_members(signatures, members), "blocks")
    for number in range(FOREST_ROUNDS + 1):
        last = number == FOREST_ROUNDS
        members = _open_members(blocks, roots)
        found = written(_tree_pairs(signatures, members, None if last else number), "tree")
        pairs = found.where("unfinished IS NULL").select("a", "b")
        # A finished block has handed on its candidates; of those it left to a block of smaller key, that one answers.
        blocks = blocks.join(found.where("unfinished IS NOT NULL").select(F.col("unfinished").alias("key")).distinct(), "key", "left_semi")
        pairs = written(pairs.unionAll(_apart(star, roots)).distinct(), "apart") if last else pairs
        if not pairs.isEmpty():
            links = links.unionAll(written(_verified(source, one, pairs), "verified"))
            roots = components(links)

    degree = links.distinct().select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("spanning_links"))
    named = rows.join(roots, rows["class"] == roots["node"], "left").join(degree, "class", "left")
    named = named.withColumn("_root", F.when(F.col("size") > 0, F.coalesce("root", "class")))
    least = named.where("size > 0").groupBy("_root").agg(F.min("_id").alias("_least")).withColumnRenamed("_root", "_r")
    out = named.join(least, F.col("_root") == F.col("_r"), "left")
    return out.select(F.col("_id").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("_least")).otherwise(F.col("_id")).alias("component_id"),
                      F.when(F.col("size") > 0, F.col("class")).alias("class_id"), F.coalesce("spanning_links", F.lit(0)).alias("spanning_links"))


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, columns unchanged, without those linked to a row of smaller id.

    Of rows equal in id and text one stays; rows without words are linked with
    nothing and all stay.
    """
    names = docs.columns
    safe = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    own, text = F.col(f"c{names.index(id_col)}"), F.col(f"c{names.index(text_col)}")
    # A row is known by its id and two hashes of its text: the same in every scan.
    safe = safe.withColumn("_row", F.struct(own.isNull().alias("n"), own.alias("id"), F.xxhash64(text).alias("h"), F.xxhash64(text, F.lit(1)).alias("g")))
    found = written(jaccard_components(safe, "_row", f"c{names.index(text_col)}"), "groups")
    out = written(found.where(F.col("_row") != F.col("component_id")).select(F.col("_row").alias("_out")).distinct(), "dropped")
    several = written(found.where("n_shingles > 0").groupBy(F.col("_row").alias("_twice")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_twice"), "repeated")
    out, several = (F.broadcast(x) if x.count() <= BROADCAST_ROWS else x for x in (out, several))
    kept = safe.join(out, F.col("_row") == F.col("_out"), "left_anti")
    twice = F.col("_row") == F.col("_twice")
    once = kept.join(several, twice, "left_anti").unionByName(kept.join(several, twice, "left_semi").dropDuplicates(["_row"]))
    return once.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def _texts(source: DataFrame, one: DataFrame, needed: DataFrame) -> DataFrame:
    """(class, at, _text) for the classes of ``needed`` (class, at), from one document each."""
    rows = written(needed.join(one, "class").select("class", "at", "_one"), "needed")
    places = F.size("at") if isinstance(rows.schema["at"].dataType, T.ArrayType) else F.lit(1)
    size = rows.agg(F.coalesce(F.sum(32 + 32 * places), F.lit(0))).first()[0]
    rows = F.broadcast(rows) if size <= BROADCAST_BYTES else rows
    return source.join(rows, F.col("_id").eqNullSafe(F.col("_one"))).select("class", "at", "_text")


def _fetched(source: DataFrame, one: DataFrame, needed: DataFrame, density: int) -> DataFrame:
    """(class, size, content, at) for the classes of ``needed`` (class, at: an array), from one document each."""
    texts = _texts(source, one, needed)
    at = next(f for f in texts.schema.fields if f.name == "at")
    schema = T.StructType([T.StructField("class", T.LongType()), T.StructField("size", T.LongType()), T.StructField("content", T.BinaryType()), at])
    return texts.mapInArrow(_contents(density), schema)


def _verified(source: DataFrame, one: DataFrame, pairs: DataFrame, bitmaps: bool = False) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach 80 % (``bitmaps``: may reach it, by their bitmaps).

    The sets of ``a`` meet that of ``b`` where it is sent: one copy of each set
    a pair.  A ``b`` of many pairs holds several meetings of at most about
    ``CHUNK``.
    """
    sizes = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("meetings"))
    members = pairs.join(sizes, "b").select(F.col("a").alias("class"), F.col("b").alias("meeting"), F.pmod(F.xxhash64("a"), F.col("meetings")).alias("room"))
    centres = sizes.select(F.col("b").alias("class"), F.col("b").alias("meeting"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("meetings") - 1)).alias("room"))
    needed = members.unionAll(centres).groupBy("class").agg(F.collect_list(F.struct("meeting", "room")).alias("at"))
    sent = _fetched(source, one, needed, NARROW_BITS if bitmaps else 0).select("class", "size", "content", F.explode("at").alias("at"))
    sent = sent.select("class", F.col("at.meeting").alias("meeting"), F.col("at.room").alias("room"), "size", "content")
    met = sent.repartition("meeting", "room").sortWithinPartitions("meeting", "room", F.col("class") != F.col("meeting"))
    return met.select("class", "meeting", "size", "content").mapInArrow(_meet(bitmaps), "a long, b long").distinct()


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    for x in "ab":
        side = roots.select(F.col("node").alias("_n"), F.col("root").alias(f"_{x}"))
        pairs = pairs.join(side, F.col(x) == F.col("_n"), "left").drop("_n")
    pairs = pairs.where(F.coalesce("_a", "a") != F.coalesce("_b", "b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _sizes_fit(small, large):
    """Whether a class of (signed) size ``small`` is early, no larger than the other and within 80 % of its size."""
    return (small > 0) & (small <= F.abs(large)) & (small * 5 >= F.abs(large) * 4)


def _open_members(blocks: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, class, root, n): the classes of blocks that hold several components, ``n`` of them."""
    members = blocks.join(roots, F.col("class") == F.col("node"), "left").select("key", "class", F.coalesce("root", "class").alias("root"))
    open_keys = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("key", "n")
    return written(members.join(open_keys, "key"), "open")


def _in_chunks(signatures: DataFrame, bitmap: str, members: DataFrame, keys: bool) -> tuple[DataFrame, DataFrame]:
    """The classes of each chunk of a block with their bitmaps: rows (key, large, rows, other) of single chunks, and of pairs of them.

    ``keys``: a class of a block of more than ``LEAF`` carries the keys of all such blocks it is in.
    """
    # A class's bitmap travels once per open block; pairs are made inside the tasks and leave them only if their bitmaps allow a link.
    members = members.withColumn("chunk", F.pmod(F.xxhash64("class"), F.ceil(F.col("n") / CHUNK)))
    needed = members.groupBy("class").agg(F.collect_list(F.struct("key", "chunk", "root", "n")).alias("at"))
    other = F.transform(F.filter("at", lambda x: x["n"] > LEAF), lambda x: x["key"]) if keys else F.lit(None).cast("array<long>")
    found = signatures.join(needed, "class").select("class", "size", F.col(bitmap).alias("bitmap"), F.explode("at").alias("at"), other.alias("keys"))
    found = found.select("class", "size", "bitmap", "at", F.when(F.col("at.n") > LEAF, F.col("keys")).alias("keys"))
    found = found.groupBy("at.key", "at.chunk", "at.n").agg(F.collect_list(F.struct("class", "size", "at.root", "bitmap", "keys")).alias("rows"))
    alone = found.select("key", (F.col("n") > LEAF).alias("large"), "rows", F.lit(None).cast(found.schema["rows"].dataType).alias("other"))
    several = found.where(F.col("n") > CHUNK)
    left, right = several.select("key", "chunk", "rows"), several.select(F.col("key").alias("k"), F.col("chunk").alias("c"), F.col("rows").alias("other"))
    return alone, left.join(right, (F.col("key") == F.col("k")) & (F.col("chunk") < F.col("c"))).select("key", F.lit(True).alias("large"), "rows", "other")


def _tree_members(signatures: DataFrame, members: DataFrame) -> DataFrame:
    """(key, class): the members that have a candidate of another component in their block, by narrow bitmaps."""
    alone, across = _in_chunks(signatures, "narrow", members, keys=False)
    found = alone.unionAll(across).select("key", "rows", "other").mapInArrow(_with_candidates, "key long, classes array<long>")
    return found.select("key", F.explode("classes").alias("class")).distinct()


def _tree_pairs(signatures: DataFrame, members: DataFrame, forest: int | None) -> DataFrame:
    """Pairs (a, b) of classes in an open block, of different components, that may link.

    ``forest``, a round's number: no more than could join the block's components, others each round;
    a block that has more gives a row with its key as ``unfinished``.
    """
    alone, across = _in_chunks(signatures, "wide", members, keys=True)
    return alone.unionAll(across).mapInArrow(_search(forest), "a long, b long, unfinished long").distinct()
