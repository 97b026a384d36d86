"""Best-fit packing of tokenised documents, certified by lower bounds.

:func:`token_pieces` turns each document into token ids (closed by an end id)
and cuts only those longer than the capacity.  :func:`pack` deals the pieces
evenly to partitions of about ``PART_PIECES`` pieces.  Each partition runs
best-fit decreasing and computes a lower bound of its bin count from
dual-feasible functions; a partition whose bin count equals its bound is
certified optimal and done.  The others keep their full bins, put the pieces of
all other bins into a common pool, exchange them with one another and run
best-fit decreasing again, in as many partitions as the pool needs, until none
has a gap, a round wins nothing (then the round before stands), the pool fits
one partition or ``MAX_ROUNDS`` have run.  What the last round leaves is packed,
only not certified; no piece is lost.

Defined results: a null or empty text is the end id alone; repeated rows are
packed as rows of their own; ties in length go by id and piece; an empty table
gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.llm.util import batches_of_bytes, written

CAPACITY = 1024
END_ID = 2
PART_PIECES = 65_536
MAX_ROUNDS = 6


# ------------------------------------------------------------------ tokens
@lru_cache(maxsize=4)
def byte_level_encoder(path: str):
    """Encoder of a byte-level BPE vocabulary (a ``tokenizers`` JSON file).

    The ids are those of the ``tokenizers`` library (tested): by ``encode`` with
    the file's added tokens allowed those of its default, without them
    those with added tokens taken as ordinary text.  The tiktoken engine
    computes them about four times as fast.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    vocab, added = model["model"]["vocab"], {t["content"]: t["id"] for t in model["added_tokens"]}
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
    rest = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if all(c in byte_of for c in token) and token not in added}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


@lru_cache(maxsize=4)
def library_encoder(path: str, added_tokens: bool):
    """The same ids by the ``tokenizers`` library, for texts beyond the other engine's stack (white space by the megabyte)."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not added_tokens
    return tokenizer


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 (of its little-endian ids).

    ``added_tokens``: the file's added tokens get their own ids in a text, as by
    the library's default; else they are ordinary text.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = byte_level_encoder(tokenizer_path)
        fast = partial(encoder.encode, allowed_special="all" if added_tokens else set(), disallowed_special=())

        def encode(text: str) -> list[int]:
            try:
                return fast(text)
            except ValueError:  # its regular expressions run out of stack
                return library_encoder(tokenizer_path, added_tokens).encode(text, add_special_tokens=False).ids

        for b in batches_of_bytes(batches, "_text"):
            ids_col, piece, start, length, crc = [], [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                first = len(ids) % capacity or capacity  # only the first piece may be shorter
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    ids_col.append(doc)
                    piece.append(k)
                    start.append(lo)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(ids[lo:hi].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids_col, b.schema.field(0).type), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([source.schema["_id"], *(T.StructField(n, t) for n, t in (
        ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())))])
    return source.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


# ------------------------------------------------------------------ bounds and best fit
def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best lower bound of the bin count from two families of dual-feasible functions.

    ``e``: lengths over ``capacity - e`` count whole, lengths under ``e`` count
    nothing.  ``k``: a length counts as floor((k + 1) x / capacity) / k, or as
    itself where that product is whole.
    """
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    upto, weight = np.cumsum(count), np.cumsum(count * size)
    for e in range(1, capacity // 2 + 1):
        middle = int(weight[capacity - e] - weight[e - 1])
        best = max(best, int(upto[-1] - upto[capacity - e]) - (-middle // capacity))
    for k in range(1, 65):
        whole = (k + 1) * size % capacity == 0
        scaled = np.where(whole, size * k, (k + 1) * size // capacity * capacity)  # times k
        best = max(best, -(-int((count * scaled).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each length, taken in the order of a stable sort from long to short, and each bin's fill."""
    place = np.zeros(len(lengths), np.int64)
    offset = np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by free space
    some = 0  # bit r set: there is a bin with r free
    free: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fitting = some >> need
        if fitting:
            r = need + (fitting & -fitting).bit_length() - 1
            at = room[r].pop()
            if not room[r]:
                some &= ~(1 << r)
        else:
            r, at = capacity, len(free)
            free.append(capacity)
        place[i], offset[i] = at, capacity - r
        free[at] = r - need
        if free[at]:
            room[free[at]].append(at)
            some |= 1 << free[at]
    return place, offset, capacity - np.array(free, np.int64)


def pack(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length", part_pieces: int = PART_PIECES) -> DataFrame:
    """``pieces`` plus sequence_id, offset: the place of each piece.  Lengths lie in 1..capacity."""
    names = pieces.columns
    safe = pieces.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(f"`{length_col}`").cast("long").alias("_length"),
                         F.monotonically_increasing_id().alias("_row"))
    state = written(safe, "pieces")
    parts = max(1, -(-state.count() // part_pieces))
    out_schema = T.StructType([*state.schema.fields, *(T.StructField(n, T.LongType()) for n in ("_seq", "_offset", "_fill", "_gap"))])

    def packer(number: int):
        def run(key, table):
            import pyarrow as pa

            table = table.drop_columns(["_part"]).sort_by("_row")
            length = table.column("_length").to_numpy()
            place, offset, fill = best_fit_decreasing(length, capacity)
            gap = len(fill) - lower_bound(length, capacity)
            seq = (number << 56) + (key[0].as_py() << 32) + place
            for name, v in (("_seq", seq), ("_offset", offset), ("_fill", fill[place]), ("_gap", np.full(len(length), gap))):
                table = table.append_column(name, pa.array(v, pa.int64()))
            return table

        return run

    done, before = [], None
    for number in range(MAX_ROUNDS):
        dealt = state.withColumn("_part", F.pmod(F.xxhash64("_row", F.lit(number)), F.lit(parts)))
        packed = written(dealt.groupBy("_part").applyInArrow(packer(number), out_schema), "packed")
        if before is not None:
            bins = packed.select("_seq").distinct().count()
            if bins >= before[0]:
                done.append(before[1])
                break
        pool = packed.where((F.col("_gap") > 0) & (F.col("_fill") < capacity))
        n = pool.count()
        done.append(packed.where((F.col("_gap") <= 0) | (F.col("_fill") >= capacity)))
        if not n:
            break
        if number + 1 == MAX_ROUNDS:
            done.append(pool)
            break
        before = (pool.select("_seq").distinct().count(), pool)
        state, parts = pool.drop("_seq", "_offset", "_fill", "_gap"), max(1, -(-n // part_pieces))
        if parts == 1 and number:
            done.append(pool)
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("_seq").alias("sequence_id"), F.col("_offset").alias("offset"))
