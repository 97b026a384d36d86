"""Exact duplicates by two-pass Bloom filtering.

Pass 1 sets, for every row's text hash, a few bits of a Bloom filter and notes
which bits were set by two rows or more.  Pass 2 tests every row: one whose
bits were not all set twice has a text that occurs once and passes straight
through.  Only the rest ("possibly repeated") is shuffled, grouped by the exact
SHA-256 and resolved, so a false positive of the filter costs a row's shuffle
and never changes a result.

The filter is cut into segments of fixed size, picked by the hash; their number
grows with the row count, so the filter's error rate does not.  Each task sends
a bit position at most twice, however often a hot text occurs.  Pass 2 ships
the "set twice" bits to the tasks in blocks of at most ``BLOCK_BYTES``; a larger
corpus takes more blocks, each tested against its own range of rows.

Defined results: a null text counts as empty; texts are equal when identical
after replacing each run of ``[\\x20\\x09-\\x0D]`` by one space; of equal texts
the smallest ``doc_id`` stays (null ids come last, and of rows with the same id
and text one stays); empty tables give empty results; other columns, whatever
their names, pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.llm.util import release_memory, written

SEGMENT_BITS = 1 << 20
BITS_PER_ROW = 24
PROBES = 3
BLOCK_BYTES = 64 << 20
HOT_GROUPS = 1000


def normalised_sha256(text: Column) -> Column:
    """SHA-256 (lower-case hex) of the text with white-space runs made one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)


def _positions(h: np.ndarray) -> np.ndarray:
    """PROBES bit positions in a segment from each 64-bit hash (double hashing)."""
    h = h.astype(np.uint64)
    a, b = h & np.uint64(0xFFFFF), (h >> np.uint64(20)) | np.uint64(1)
    return np.stack([(a + np.uint64(k) * b) % np.uint64(SEGMENT_BITS) for k in range(PROBES)], 1).astype(np.int64)


def _pass_one(segments: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        once = np.zeros(0, np.int64)
        twice = np.zeros(0, np.int64)

        def fold(once, twice, pending):
            every, n = np.unique(np.concatenate([once, *pending]), return_counts=True)
            return every, np.union1d(twice, every[n > 1])

        pending, held = [], 0
        for b in batches:
            h = b.column(0).to_numpy()
            seg = b.column(1).to_numpy().astype(np.int64)
            pos = np.sort(seg[:, None] * SEGMENT_BITS + _positions(h), 1)
            dup = np.zeros(pos.shape, bool)
            dup[:, 1:] = pos[:, 1:] == pos[:, :-1]  # a row sets each of its bits once
            pending.append(pos[~dup])
            held += len(pending[-1])
            if held > 1_000_000:
                once, twice = fold(once, twice, pending)
                pending, held = [], 0
        once, twice = fold(once, twice, pending)
        for flag, every in ((1, once), (2, twice)):
            seg = every // SEGMENT_BITS
            cut = np.flatnonzero(np.diff(seg)) + 1
            parts = np.split(every, cut) if len(every) else []
            for lo in range(0, len(parts), 64):
                some = parts[lo:lo + 64]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(p[0] // SEGMENT_BITS) for p in some], pa.int64()), pa.array([flag] * len(some), pa.int32()),
                     pa.array([(p % SEGMENT_BITS).astype(np.uint32).tobytes() for p in some], pa.binary())], ["segment", "times", "bits"])
        del once, twice, every, parts
        release_memory()

    return run


def _merge_segment(table):
    """One segment: positions set by two rows or more, over all tasks."""
    import pyarrow as pa

    count = np.zeros(SEGMENT_BITS, np.uint8)
    for times, bits in zip(table.column("times").to_pylist(), table.column("bits").to_pylist()):
        pos = np.frombuffer(bits, np.uint32)
        count[pos] = np.minimum(count[pos] + (1 if times == 1 else 2), 2)
    bits = np.packbits(count == 2).tobytes()
    return pa.table({"segment": pa.array([table.column("segment")[0].as_py()], pa.int64()), "twice": pa.array([bits], pa.binary())})


def _pass_two(bits, lo: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        every = bits.value
        for b in batches:
            h, seg = b.column("_h").to_numpy(), b.column("_segment").to_numpy().astype(np.int64)
            at = (seg - lo)[:, None] * SEGMENT_BITS + _positions(h)
            hit = ((every[at >> 3] >> (7 - (at & 7))) & 1).all(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hit)], [*b.schema.names, "_maybe"])
        release_memory()

    return run


def _segments(rows: int) -> int:
    return 1 << max(0, (max(1, rows * BITS_PER_ROW // SEGMENT_BITS) - 1).bit_length())


def _hashed(df: DataFrame, segments: int) -> DataFrame:
    return df.withColumn("_h", F.xxhash64("_sha")).withColumn("_segment", F.pmod(F.xxhash64("_sha", F.lit(7)), F.lit(segments)))


def flag_repeats(frame: DataFrame, hashes: DataFrame, rows: int) -> DataFrame:
    """``frame`` (with a column ``_sha``) plus ``_maybe``: False where the hash surely
    occurs once in ``hashes`` (one row per row of the corpus, column ``_sha``)."""
    spark = frame.sparkSession
    segments = _segments(rows)
    sent = _hashed(hashes.select("_sha"), segments).select("_h", "_segment").mapInArrow(_pass_one(segments), "segment long, times int, bits binary")
    twice = written(sent.groupBy("segment").applyInArrow(_merge_segment, "segment long, twice binary"), "bloom")
    per_block = max(1, BLOCK_BYTES * 8 // SEGMENT_BITS)
    out = None
    for lo in range(0, segments, per_block):
        hi = min(segments, lo + per_block)
        block = np.zeros((hi - lo, SEGMENT_BITS // 8), np.uint8)
        for r in twice.where(F.col("segment").between(lo, hi - 1)).toLocalIterator():
            block[r["segment"] - lo] = np.frombuffer(r["twice"], np.uint8)
        some = _hashed(frame, segments)
        some = some if hi - lo == segments else some.where(F.col("_segment").between(lo, hi - 1))
        schema = T.StructType([*some.schema.fields, T.StructField("_maybe", T.BooleanType())])
        some = some.mapInArrow(_pass_two(spark.sparkContext.broadcast(block.reshape(-1)), lo), schema).drop("_h", "_segment")
        out = some if out is None else out.unionByName(some)
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, keep_id, group_size, kept, text_sha256."""
    prints = written(docs.select(F.col(id_col).alias("_id"), normalised_sha256(F.col(text_col)).alias("_sha"), F.monotonically_increasing_id().alias("_row")), "prints")
    rows = prints.count()
    flagged = flag_repeats(prints, prints, rows)
    repeated = flagged.where("_maybe")
    groups = repeated.groupBy("_sha").agg(
        F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_row").alias("row"))).alias("_keep"), F.count(F.lit(1)).alias("_n"))
    groups = written(groups, "groups")
    # Large groups (at most HOT_GROUPS hold a share of 1 / HOT_GROUPS each) are broadcast, so that none meets in one task.
    large = F.col("_n") >= max(2, -(-rows // HOT_GROUPS))
    near = repeated.join(F.broadcast(groups.where(large)), "_sha", "left")
    hot = near.where("_n IS NOT NULL")
    cold = near.where("_n IS NULL").drop("_keep", "_n").join(groups.where(~large), "_sha")
    resolved = hot.unionByName(cold).select(
        F.col("_id").alias(id_col), F.col("_keep.id").alias("keep_id"), F.col("_n").alias("group_size"), (F.col("_row") == F.col("_keep.row")).alias("kept"), F.col("_sha").alias("text_sha256"))
    single = flagged.where(~F.col("_maybe")).select(
        F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("_sha").alias("text_sha256"))
    return single.unionAll(resolved)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are."""
    names = docs.columns
    safe = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    of = {c: f"c{i}" for i, c in enumerate(names)}
    frame = safe.withColumn("_sha", normalised_sha256(F.col(of[text_col])))
    prints = written(frame.select(F.col(of[id_col]).alias("_id"), "_sha"), "prints")
    rows = prints.count()
    flagged = flag_repeats(frame, prints, rows)
    keep = flag_repeats(prints, prints, rows).where("_maybe").groupBy("_sha").agg(F.min("_id").alias("_keep"))
    stay = flagged.where("_maybe").join(keep, (flagged["_sha"] == keep["_sha"]) & flagged[of[id_col]].eqNullSafe(keep["_keep"]), "left_semi")
    stay = stay.dropDuplicates(["_sha", of[id_col]])
    every = flagged.where(~F.col("_maybe")).unionByName(stay)
    return every.select(*[F.col(of[c]).alias(c) for c in names])
