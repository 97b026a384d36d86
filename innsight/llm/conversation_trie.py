"""Prefix trie of conversations: what shared first turns would save.

Conversations are sequences of (role, text) turns; a node is a distinct sequence
of first turns, and its members are the conversations that begin with it.

1. *Encoding.*  A turn becomes a 16-byte digest and its length, so texts leave
   the first scan only as those.  Equal conversations are counted together
   before anything else, so a conversation with many copies is one row.
2. *Range shards.*  Distinct sequences are cut into ranges of their order.  A
   shard encodes its turns by a dictionary of its own and inserts its sequences,
   the median first, then the medians of both halves, into a ternary search
   tree, which is balanced that way.
3. *Traversal.*  An iterative walk lists the nodes parents first; backwards over
   it, members, leaves and savings are accumulated.  All nodes but those on the
   path of the shard's first or last sequence are complete.
4. *Boundary nodes* of neighbouring shards are merged by the digest of their
   prefix, and their sums are carried up by pointer doubling: as many joins as
   the logarithm of the depth, over the boundary nodes only.

The digest of a node's end members is streamed over sorted ids: ranges of (node,
id) give it for groups within one task, and a group cut by a range is continued
from its pieces of text in order.

Defined results: a null role or text is empty; equal turn numbers are ordered by
the digest of role and text; repeated rows are turns of their own; rows without
a conversation id belong to none and are left out; an empty table gives no
nodes, not even the root; other columns are not read.  A task holds a shard of about
``SHARD_TURNS`` turns, or one conversation's turns (24 bytes each) if that is longer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.llm.util import written

WIDTH = 16  # bytes of a digest
SHARD_TURNS = 50_000
PIECE = 1 << 20  # characters of ids passed on at once
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _digest(c: Column) -> Column:
    return F.substring(F.unhex(F.sha2(c, 256)), 1, WIDTH)


# ------------------------------------------------------------------ conversations as sequences
def conversations(turns: DataFrame, block: int = 1, spliced: Column | None = None) -> DataFrame:
    """(conv_id, path, seq, chars): each conversation's turn digests in order, their digest and the turns' code points.

    With ``block``, the first ``spliced`` turns (fewer than ``block``'s head
    holds: 5 at most) are those of the conversation whose id is ``conv_id - conv_id % block`` (the remainder has the sign of the id, as in SQL).
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = _digest(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), key.alias("key"), F.length(text).alias("chars")).alias("t"))
    rows = rows.where("conv_id IS NOT NULL").withColumn("base", F.col("conv_id") - F.col("conv_id") % block)
    own = rows.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    seq = F.col("own")
    if spliced is not None:
        own = written(own, "turns")
        heads = own.where("conv_id = base").select(F.col("conv_id").alias("head_id"), F.slice("own", 1, 5).alias("head"))
        own = own.join(heads, F.col("base") == F.col("head_id"), "left").withColumn("h", spliced.cast("int"))
        rest = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
        seq = F.concat(F.when(F.col("head").isNull(), F.slice("own", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h"))), rest)
    out = own.withColumn("seq", seq).select("conv_id", F.unhex(F.array_join(F.transform("seq", lambda t: F.hex(t["key"])), "")).alias("seq"),
                                            F.transform("seq", lambda t: t["chars"]).alias("chars"))
    return out.select("conv_id", _digest(F.col("seq")).alias("path"), "seq", "chars")


# ------------------------------------------------------------------ digests of the members that end at a node
def _sorted_ids(batches: Iterator) -> Iterator:
    """Rows (path, id) in order -> the digest of each path whose ids all lie here, pieces of text of the first and last."""
    import pyarrow as pa

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.string(), pa.int64(), pa.string()))],
                                          ["path", "ends", "at", "piece"])

    path, ids, size, cut = None, [], 0, True  # the first path may begin in the range before
    for b in batches:
        out = []
        for p, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if p != path and path is not None:
                text = ",".join(map(str, ids))
                out.append((path, None, ids[0], text) if cut else (path, hashlib.sha256(text.encode()).hexdigest(), None, None))
                ids, size, cut = [], 0, False
            elif size > PIECE:
                out.append((path, None, ids[0], ",".join(map(str, ids))))
                ids, size, cut = [], 0, True
            path = p
            ids.append(i)
            size += len(str(i)) + 1
        if out:
            yield rows(out)
    if ids:
        yield rows([(path, None, ids[0], ",".join(map(str, ids)))])


def _joined(batches: Iterator) -> Iterator:
    """Pieces (path, at, piece) in order -> the digest of each path."""
    import pyarrow as pa

    path, state, done = None, None, []
    for b in batches:
        for p, piece in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            if p != path:
                if path is not None:
                    done.append((path, state.hexdigest()))
                path, state = p, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
    if path is not None:
        done.append((path, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], ["path", "ends"])


def end_digests(members: DataFrame, ranges: int) -> DataFrame:
    """(path, ends): SHA-256 of the ascending, comma-joined ids of each path."""
    ids = members.select("path", "conv_id").repartitionByRange(ranges, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    found = written(ids.mapInArrow(_sorted_ids, "path binary, ends string, at long, piece string"), "ends")
    pieces = found.where("ends IS NULL").select("path", "at", "piece").repartition("path").sortWithinPartitions("path", "at")
    return found.where("ends IS NOT NULL").select("path", "ends").unionAll(pieces.mapInArrow(_joined, "path binary, ends string"))


# ------------------------------------------------------------------ ternary search tree of a shard
class TernaryTree:
    """Sequences of dictionary ids.  Node 0 is the empty prefix; the others are one prefix each."""

    def __init__(self):
        self.split, self.lo, self.eq, self.hi, self.up = [-1], [-1], [-1], [-1], [-1]

    def insert(self, ids: list[int]) -> list[int]:
        """The nodes of all prefixes of ``ids``, created where missing."""
        split, lo, eq, hi = self.split, self.lo, self.eq, self.hi
        node, path = 0, [0]
        for x in ids:
            link, at = eq, node  # where the next node hangs
            found = eq[node]
            while found >= 0 and split[found] != x:
                link, at = (lo, found) if x < split[found] else (hi, found)
                found = link[at]
            if found < 0:
                found = len(split)
                link[at] = found
                for field, v in ((split, x), (lo, -1), (eq, -1), (hi, -1), (self.up, node)):
                    field.append(v)
            node = found
            path.append(node)
        return path

    def walk(self) -> list[int]:
        """All nodes, each after its parent."""
        out, todo = [], [0]
        while todo:
            node = todo.pop()
            out.append(node)
            todo += [x for x in (self.hi[node], self.lo[node], self.eq[node]) if x >= 0]
        return out


def medians(n: int) -> Iterator[int]:
    """0 to n - 1, each range's median before the rest of it."""
    todo = [(0, n)]
    while todo:
        lo, hi = todo.pop()
        if lo < hi:
            mid = (lo + hi) // 2
            yield mid
            todo += [(mid + 1, hi), (lo, mid)]


def _dictionary(seqs: list[bytes]) -> np.ndarray:
    """Dense ids, in order, of the turns of all sequences one after the other."""
    turn = np.frombuffer(b"".join(seqs), ">u8").reshape(-1, WIDTH // 8).astype(np.uint64)
    order = np.lexsort((turn[:, 1], turn[:, 0]))
    new = np.zeros(len(turn), np.int64)
    new[1:] = (turn[order[1:]] != turn[order[:-1]]).any(axis=1)
    ids = np.empty(len(turn), np.int64)
    ids[order] = np.cumsum(new)
    return ids


FIELDS = ("shard", "boundary", "node", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "chars", "ends")
SHARD_SCHEMA = ("shard binary, boundary boolean, node binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
                "n_leaves long, saved_tokens long, chars long, ends string")


def shard_nodes(rows: list[tuple]) -> list[tuple]:
    """Nodes (:data:`FIELDS`) of a shard's distinct sequences (seq, chars, n, least id, ends), in order.

    Nodes on the path of the first or last sequence are ``boundary`` nodes: their
    counts cover the shard's complete nodes below them only, ``n_convs`` all members.
    """
    seqs = [r[0] for r in rows]
    ids = _dictionary(seqs).tolist()
    first = np.concatenate([[0], np.cumsum([len(s) // WIDTH for s in seqs])]).tolist()
    tree = TernaryTree()
    chars, depth, prefix = [0], [0], {0: b""}
    n, least, ends = [0], [None], {}
    for k in medians(len(rows)):
        seq, length, count, smallest, digest = rows[k]
        path = tree.insert(ids[first[k]:first[k + 1]])
        for d in range(len(chars) - len(tree.split), 0):  # nodes made for this sequence, its last ones
            at = len(path) + d
            chars.append(length[at - 1])
            depth.append(at)
            n.append(0)
            least.append(None)
        if k in (0, len(rows) - 1):
            prefix |= {node: seq[:WIDTH * d] for d, node in enumerate(path)}
        end = path[-1]
        n[end], least[end], ends[end] = count, smallest, digest
    order = tree.walk()
    children, leaves, saved = [0] * len(n), [0] * len(n), [0] * len(n)
    for node in reversed(order[1:]):
        up = tree.up[node]
        n[up] += n[node]
        least[up] = least[node] if least[up] is None else min(least[up], least[node])
        if node not in prefix:
            leaves[node] += children[node] == 0
            saved[node] += (n[node] - 1) * chars[node]
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
    key = {node: hashlib.sha256(p).digest()[:WIDTH] for node, p in prefix.items()}
    shard = hashlib.sha256(seqs[0]).digest()[:WIDTH]
    return [(shard, node in key, key.get(node), key.get(tree.up[node]), depth[node], least[node],
             least[tree.up[node]] if node and tree.up[node] not in key else None,
             n[node], children[node], leaves[node], saved[node], chars[node], ends.get(node)) for node in order]


def _shards(batches: Iterator) -> Iterator:
    import pyarrow as pa

    rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[0])
    if not rows:
        return
    types = [{"boolean": pa.bool_(), "binary": pa.binary(), "long": pa.int64(), "string": pa.string()}[f.split()[1]] for f in SHARD_SCHEMA.split(", ")]
    out = shard_nodes(rows)
    for lo in range(0, len(out), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[lo:lo + 50_000]), types)], list(FIELDS))


# ------------------------------------------------------------------ boundary nodes
def _merged(boundary: DataFrame) -> DataFrame:
    """The boundary nodes of all shards as whole nodes (node, parent, depth, conv_id, n_convs, n_children, n_leaves, saved_tokens, ends)."""
    one = boundary.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("chars").alias("chars"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("ends").alias("ends"))
    kids = one.groupBy(F.col("parent").alias("_p")).agg(F.count(F.lit(1)).alias("_kids"))
    one = one.join(kids, F.col("node") == F.col("_p"), "left").withColumn("n_children", F.col("n_children") + F.coalesce("_kids", F.lit(0)))
    one = one.withColumns({"n_leaves": F.col("n_leaves") + (F.col("n_children") == 0).cast("long"),
                           "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars")}).drop("_p", "_kids", "chars")
    one = written(one, "boundary")
    deepest = one.agg(F.max("depth")).first()[0] or 0
    sums, reach = one.select("node", F.col("parent").alias("up"), "n_leaves", "saved_tokens"), 1
    while reach <= deepest:  # sums cover descendants nearer than reach; up is the ancestor at that distance
        below = sums.where("up IS NOT NULL").groupBy(F.col("up").alias("_u")).agg(F.sum("n_leaves").alias("_l"), F.sum("saved_tokens").alias("_s"))
        further = sums.select(F.col("node").alias("_n"), F.col("up").alias("_next"))
        sums = sums.join(below, F.col("node") == F.col("_u"), "left").join(further, F.col("up") == F.col("_n"), "left").select(
            "node", F.col("_next").alias("up"), (F.col("n_leaves") + F.coalesce("_l", F.lit(0))).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("_s", F.lit(0))).alias("saved_tokens"))
        sums, reach = written(sums, "sums"), 2 * reach
    return one.drop("n_leaves", "saved_tokens").join(sums.drop("up"), "node")


def prefix_trie(members: DataFrame) -> DataFrame:
    """One row per node of the trie of ``members`` (conv_id, path, seq, chars; see :func:`conversations`): conv_id (smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = members.sparkSession
    members = written(members, "conversations")
    distinct = members.groupBy("path").agg(F.first("seq").alias("seq"), F.first("chars").alias("chars"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"))
    distinct = written(distinct, "sequences")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = distinct.agg(F.sum(F.size("chars")), F.sum("n")).first()
    ends = end_digests(members, max(ranges, -(-(total[1] or 0) // SHARD_TURNS)))
    rows = distinct.join(ends, "path").select("seq", "chars", "n", "least", "ends")
    shards = rows.repartitionByRange(max(ranges, -(-(total[0] or 0) // SHARD_TURNS)), "seq").mapInArrow(_shards, SHARD_SCHEMA)
    shards = written(shards, "shards")
    boundary = shards.where("boundary")
    merged = written(_merged(boundary), "merged")
    named = merged.select(F.col("node").alias("_node"), F.col("conv_id").alias("_conv"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256")]
    inner = shards.where("NOT boundary")
    # A boundary node's smallest member is looked up per shard, so a node with many children in all shards is no hot key.
    places = boundary.select(F.col("shard").alias("_shard"), F.col("node").alias("_at")).join(named, F.col("_at") == F.col("_node")).drop("_node")
    below = inner.where("parent IS NOT NULL").join(places, (F.col("shard") == F.col("_shard")) & (F.col("parent") == F.col("_at")))
    parts = [inner.where("parent IS NULL"), below.withColumn("parent_conv_id", F.col("_conv")),
             merged.join(named, F.col("parent") == F.col("_node"), "left").withColumn("parent_conv_id", F.col("_conv"))]
    return parts[0].select(*columns).unionAll(parts[1].select(*columns)).unionAll(parts[2].select(*columns))
