"""Removal of repeated byte strings, exact, by hash-compared suffix sorting.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier
(in a document of smaller id, or further left in the same one).  Sorting every
suffix of a corpus would move each byte many times over, so suffixes are sampled
without loss: the *anchor* of a ``LENGTH``-byte window is the position, among the
``GRAM``-byte strings inside it, of the one with the least hash (leftmost on
ties).  Equal windows have equal anchors at equal offsets, and one anchor serves
a run of windows (a *segment*): about one in 35 bytes is an anchor.

1. Segments are dealt by the hash of their anchor's gram.  Segments with the
   same gram and the same whole content are one class: all but the first are
   removed outright.  A gram with several classes is *mixed*: its windows may
   agree in part, where a copied passage begins or ends.
2. For the first segment of each class of a mixed gram the bytes are fetched in
   a second pass and dealt by gram.  The suffixes at the anchors are sorted by
   mergesort; a comparison finds the common extension of two suffixes by binary
   search over prefix polynomial hashes.  Neighbours' extensions are verified
   on the bytes, so a hash collision cannot pass.  The same is done to the left.
   Two windows at the same offset are equal where no neighbour in between falls
   short to the left or right; the earliest of equal windows stays.
3. Removed spans join their documents in key ranges, by id.

The second pass picks its segments by a Bloom filter of the mixed ones, if it fits
``BLOOM_BYTES``, or else by a join of the texts with their positions.  False
positives cost bytes, not results.  Every task's memory is bounded: texts are
taken in slices of ``SLICE`` bytes (longer ones overlap), ranges grow in number
with the corpus.  A hot passage with copies in a third of all documents makes
one row per copy in each of its segments' ranges, and only one of its copies'
bytes are fetched.

Defined results: null texts are empty; texts shorter than ``LENGTH`` lose
nothing; where ids repeat, are null or are no integers, rows are numbered by
(id, text), null ids last, and each row is a document of its own; empty tables
give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.llm.util import concat_text, mix, prefix_hashes, span_hashes, written

LENGTH = 100
GRAM = 32
SLICE = 3 << 20
RANGE_SEGMENTS = 400_000
RANGE_BYTES = 24 << 20
BLOOM_BITS = 20  # per mixed segment
BLOOM_BYTES = 64 << 20
REACH = LENGTH - GRAM  # a window holds REACH + 1 grams
CELLS = 40_000  # suffixes sorted together


# ------------------------------------------------------------------ segments of a text
def _slices(batches: Iterator) -> Iterator:
    """(documents, bytes, offset of each document's bytes, position of its first byte) in slices of about SLICE bytes.

    A longer text is cut into slices that overlap by LENGTH - 1 bytes, so that each window is in one.
    """
    for b in batches:
        docs = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        data, offsets = concat_text(b.column(1))
        lo = 0
        while lo < len(docs):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)
            part = data[offsets[lo]:offsets[hi]]
            if hi == lo + 1 and len(part) > SLICE + LENGTH:
                for at in range(0, len(part) - LENGTH + 1, SLICE):
                    piece = part[at:at + SLICE + LENGTH - 1]
                    yield docs[lo:hi], piece, np.array([0, len(piece)]), np.array([at])
            else:
                yield docs[lo:hi], part, offsets[lo:hi + 1] - offsets[lo], np.zeros(hi - lo, np.int64)
            lo = hi


def segments(data: np.ndarray, offsets: np.ndarray):
    """(row, first window, last window, anchor, gram hash, content hash) of every segment; positions in ``data``."""
    n = len(data)
    if n < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    prefix = prefix_hashes(data)
    start = np.arange(n - GRAM + 1)
    gram = span_hashes(prefix, start, start + GRAM)
    least, at = gram, start.astype(np.int32)
    reach = 1  # least[i] covers the grams i .. i + reach - 1
    while reach < REACH + 1:
        step = min(reach, REACH + 1 - reach)
        right = least[step:] < least[:-step]
        at = np.where(right, at[step:], at[:-step])
        least = np.where(right, least[step:], least[:-step])
        reach += step
    windows = len(least)  # n - LENGTH + 1
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:windows]
    inside = np.arange(windows) + LENGTH <= offsets[1:][row]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    end = inside.copy()
    end[:-1] &= ~inside[1:] | begin[1:]
    low, high = np.flatnonzero(begin), np.flatnonzero(end)
    anchor = at[low].astype(np.int64)
    return row[low], low, high, anchor, gram[anchor], span_hashes(prefix, low, high + LENGTH)


def _identity(doc: np.ndarray, low: np.ndarray) -> np.ndarray:
    return mix(mix(doc.view(np.uint64)) + low.astype(np.uint64))


def _by_part(part: np.ndarray):
    """(order, cuts) that group rows by ``part``."""
    order = np.argsort(part, kind="stable")
    return order, np.concatenate([[0], np.flatnonzero(np.diff(part[order])) + 1, [len(part)]])


def _lists(order, cut, **columns):
    import pyarrow as pa

    return [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(v[order])) for v in columns.values()]


_SEGMENTS = "part long, grams array<long>, contents array<long>, docs array<long>, lows array<int>, lefts array<tinyint>, counts array<tinyint>"


def _send_segments(ranges: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for docs, data, offsets, base in _slices(batches):
            row, low, high, anchor, gram, content = segments(data, offsets)
            if not len(row):
                continue
            part = (gram % np.uint64(ranges)).astype(np.int64)
            order, cut = _by_part(part)
            place = (low - offsets[row] + base[row]).astype(np.int32)
            lists = _lists(order, cut, g=gram.view(np.int64), c=content.view(np.int64), d=docs[row], p=place,
                           a=(anchor - low).astype(np.int8), n=(high - low).astype(np.int8))
            yield pa.RecordBatch.from_arrays([pa.array(part[order][cut[:-1]]), *lists], [f.split()[0] for f in _SEGMENTS.split(", ")])

    return run


def _gather(batches: Iterator, columns) -> list[np.ndarray]:
    found = [[] for _ in columns]
    for b in batches:
        for into, c in zip(found, columns):
            into.append(b.column(c).flatten().to_numpy())
    return [np.concatenate(f) if f else np.zeros(0, np.int64) for f in found]


_SPANS = "bucket long, docs array<long>, starts array<int>, ends array<int>, mixed boolean"


def _span_batch(doc, start, end, buckets: int, mixed: bool):
    import pyarrow as pa

    bucket = _bucket(doc, buckets)
    order, cut = _by_part(bucket)
    lists = _lists(order, cut, d=doc, s=start.astype(np.int32), e=end.astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(bucket[order][cut[:-1]]), *lists, pa.array([mixed] * (len(cut) - 1))], ["bucket", "docs", "starts", "ends", "mixed"])


def _classes(buckets: int):
    """Spans removed outright (mixed: False) and the first segments of mixed grams (mixed: True)."""

    def run(batches: Iterator) -> Iterator:
        gram, content, doc, low, count = _gather(batches, ("grams", "contents", "docs", "lows", "counts"))
        if not len(gram):
            return
        low, count = low.astype(np.int64), count.astype(np.int64)
        order = np.lexsort((low, doc, content, gram))
        gram, content, doc, low, count = (x[order] for x in (gram, content, doc, low, count))
        new_gram = np.ones(len(gram), bool)
        new_gram[1:] = gram[1:] != gram[:-1]
        first = new_gram.copy()
        first[1:] |= content[1:] != content[:-1]
        again = ~first
        if again.any():
            yield _span_batch(doc[again], low[again], low[again] + count[again] + LENGTH, buckets, False)
        group = np.cumsum(new_gram) - 1
        mixed = first & (np.bincount(group, weights=first)[group] > 1)
        if mixed.any():
            yield _span_batch(doc[mixed], low[mixed], low[mixed] + count[mixed] + LENGTH, buckets, True)

    return run


# ------------------------------------------------------------------ the mixed segments
def _bloom_positions(identity: np.ndarray, bits: int) -> np.ndarray:
    return np.stack([identity % np.uint64(bits), mix(identity + np.uint64(1)) % np.uint64(bits)], 1).astype(np.int64)


_BLOCK = 1 << 20


def _bloom_parts(bits: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            at = np.unique(_bloom_positions(_identity(b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy()), bits))
            block = at // _BLOCK
            cut = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
            yield pa.RecordBatch.from_arrays([pa.array(block[cut[:-1]]), pa.array([(at[i:j] % _BLOCK).astype(np.uint32).tobytes() for i, j in zip(cut, cut[1:])], pa.binary())],
                                             ["block", "at"])

    return run


def _bloom_block(table):
    import pyarrow as pa

    bits = np.zeros(_BLOCK, bool)
    for at in table.column("at").to_pylist():
        bits[np.frombuffer(at, np.uint32)] = True
    return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


_BYTES = "part long, grams array<long>, docs array<long>, lows array<int>, lefts array<tinyint>, counts array<tinyint>, bytes binary"


def _send_bytes(ranges: int, bits: int, bloom):
    """The segments that the filter (or, without one, the list of the document's positions) picks, with their bytes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def picked(docs, place, row, wanted):
            if bloom is None:
                return np.isin(_identity(docs[row], place), wanted)
            at = _bloom_positions(_identity(docs[row], place), bits)
            return ((bloom.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1)

        def sliced():
            for b in batches:
                wanted = None
                if bloom is None:
                    of = np.repeat(b.column(0).to_numpy(), [len(x) for x in b.column(2).to_pylist()])
                    wanted = _identity(of, b.column(2).flatten().to_numpy())
                for s in _slices([b]):
                    yield *s, wanted

        for docs, data, offsets, base, wanted in sliced():
            row, low, high, anchor, gram, _ = segments(data, offsets)
            place = low - offsets[row] + base[row]
            ok = picked(docs, place, row, wanted)
            row, low, high, anchor, gram, place = (x[ok] for x in (row, low, high, anchor, gram, place))
            if not len(row):
                continue
            part = (gram % np.uint64(ranges)).astype(np.int64)
            order, cut = _by_part(part)
            lists = _lists(order, cut, g=gram.view(np.int64), d=docs[row], p=place.astype(np.int32), a=(anchor - low).astype(np.int8), n=(high - low).astype(np.int8))
            raw = data.tobytes()
            sent = [b"".join([raw[x:y] for x, y in zip(low[some].tolist(), (high[some] + LENGTH).tolist())]) for some in (order[i:j] for i, j in zip(cut, cut[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array(part[order][cut[:-1]]), *lists, pa.array(sent, pa.binary())], [f.split()[0] for f in _BYTES.split(", ")])

    return run


class SuffixSorter:
    """Sorts rows of bytes within groups by mergesort with hash comparisons."""

    def __init__(self, table: np.ndarray, width: np.ndarray):
        self.table, self.width = table, width
        self.hash = np.zeros((len(table), table.shape[1] + 1), np.uint64)
        for i in range(table.shape[1]):
            self.hash[:, i + 1] = self.hash[:, i] * np.uint64(0x5851F42D4C957F2D) + table[:, i].astype(np.uint64) + np.uint64(1)

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix of rows x and y, by binary search over prefix hashes."""
        low, high = np.zeros(len(x), np.int64), np.minimum(self.width[x], self.width[y])
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.hash[x, middle] == self.hash[y, middle]
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n = self.extension(x, y)
        over_x, over_y = n == self.width[x], n == self.width[y]
        last = self.table.shape[1] - 1
        byte = self.table[x, np.minimum(n, last)] < self.table[y, np.minimum(n, last)]
        return np.where(over_x | over_y, over_x & ~over_y, byte)

    def sort(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, extension with the row before in it; -1 at the first of a group).  ``group`` ascends."""
        n = len(group)
        order = np.arange(n)
        start = np.searchsorted(group, group)
        stop = np.searchsorted(group, group, "right")
        width = 1
        while n and width < (stop - start).max():
            at = np.flatnonzero(stop - start > width)  # places whose group still has several runs
            run = (at - start[at]) // width
            left = run % 2 == 0
            other = start[at] + np.where(left, run + 1, run - 1) * width  # the run to merge with
            low = np.minimum(other, stop[at])
            high = np.minimum(other + width, stop[at])
            first = low.copy()
            item = order[at]
            while (low < high).any():
                open_ = np.flatnonzero(low < high)
                middle = (low[open_] + high[open_]) // 2
                x, y = item[open_], order[middle]
                # on ties the left run goes first
                before = np.where(left[open_], self.less(y, x), ~self.less(x, y))
                low[open_], high[open_] = np.where(before, middle + 1, low[open_]), np.where(before, high[open_], middle)
            pair = start[at] + run // 2 * 2 * width
            own = at - (start[at] + run * width)
            order[pair + own + (low - first)] = item
            width *= 2
        extension = np.full(n, -1, np.int64)
        inner = np.flatnonzero(group[1:] == group[:-1]) + 1
        x, y = order[inner - 1], order[inner]
        found = self.extension(x, y)
        extension[inner] = self._verified(x, y, found)
        return order, extension

    def _verified(self, x: np.ndarray, y: np.ndarray, found: np.ndarray) -> np.ndarray:
        """The extensions on the bytes themselves; a hash collision raises."""
        places = np.arange(self.table.shape[1])
        short = np.minimum(self.width[x], self.width[y])
        for lo in range(0, len(x), 20_000):
            s = slice(lo, lo + 20_000)
            differ = (self.table[x[s]] != self.table[y[s]]) | (places >= short[s][:, None])
            true = np.where(differ.any(1), differ.argmax(1), short[s])
            if (true != found[s]).any():
                raise ArithmeticError("two byte strings share a polynomial hash")
        return found


def repeated_windows(gram, doc, low, left, count, raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, start) of the windows that also occur in an earlier segment of the same gram.

    ``raw`` holds the segments' bytes side by side; ``left`` is the anchor's place in a segment.
    """
    length = count + LENGTH
    offset = np.cumsum(length) - length
    order = np.lexsort((low, doc, gram))
    sizes = np.bincount(np.cumsum(np.concatenate([[0], np.diff(gram[order]) != 0])), minlength=1)
    ends = np.cumsum(sizes)
    data = np.frombuffer(raw, np.uint8)
    lo = 0
    while lo < len(order):
        hi = int(ends[max(np.searchsorted(ends, lo + CELLS, "right") - 1, np.searchsorted(ends, lo, "right"))])  # whole grams
        some = order[lo:hi]
        lo = hi
        new = np.concatenate([[True], gram[some][1:] != gram[some][:-1]])
        group = np.cumsum(new) - 1
        several = np.bincount(group)[group] > 1
        some, group = some[several], group[several]
        if not len(some):
            continue
        a, n = left[some], len(some)
        right_width, left_width = length[some] - a, a
        places = np.arange(int(right_width.max()))
        inside = places < right_width[:, None]
        to_right = np.where(inside, data[np.where(inside, (offset[some] + a)[:, None] + places, 0)], 0).astype(np.uint8)
        places = np.arange(max(1, int(left_width.max())))
        inside = places < left_width[:, None]
        to_left = np.where(inside, data[np.where(inside, (offset[some] + a - 1)[:, None] - places, 0)], 0).astype(np.uint8)
        right_order, right_ext = SuffixSorter(to_right, right_width).sort(group)
        left_order, left_ext = SuffixSorter(to_left, left_width).sort(group)
        label_right, label_left = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for back in range(REACH + 1):  # windows that start ``back`` bytes before the anchor
            valid = np.flatnonzero((back <= a) & (back >= a - count[some]))
            if len(valid) < 2:
                continue
            label_right[right_order] = np.cumsum(right_ext < LENGTH - back)
            label_left[left_order] = np.cumsum(left_ext < back)
            both = label_right[valid] * (n + 1) + label_left[valid]
            by = np.argsort(both, kind="stable")  # stable: the earliest of equal windows comes first
            later = valid[by[1:][both[by[1:]] == both[by[:-1]]]]
            if len(later):
                yield doc[some[later]], low[some[later]] + a[later] - back


def _resolve(buckets: int):
    def run(batches: Iterator) -> Iterator:
        parts, raws = [], []
        for b in batches:
            parts.append([b.column(i).flatten().to_numpy() for i in range(1, 6)])
            raws += b.column(6).to_pylist()
        if not parts:
            return
        gram, doc, low, left, count = (np.concatenate(x).astype(np.int64) for x in zip(*parts))
        docs, starts = [], []
        for d, p in repeated_windows(gram, doc, low, left, count, b"".join(raws)):
            docs.append(d)
            starts.append(p)
        if docs:
            d, p = np.concatenate(docs), np.concatenate(starts)
            by = np.lexsort((p, d))
            d, p = d[by], p[by]
            first = np.concatenate([[True], (d[1:] != d[:-1]) | (p[1:] > p[:-1] + LENGTH)])  # touching windows make one span
            last = np.concatenate([np.flatnonzero(first)[1:] - 1, [len(d) - 1]])
            yield _span_batch(d[first], p[first], p[last] + LENGTH, buckets, False)

    return run


# ------------------------------------------------------------------ the operator
def _cut(docs, spans):
    """Cogroup of a bucket: documents (_row, _id, _text) and their spans."""
    return _cut_rows(docs, spans, "kept")


def _cut_digest(docs, spans):
    return _cut_rows(docs, spans, "kept_sha256")


def _cut_rows(docs, spans, result: str):
    import pyarrow as pa

    of, start, end = (np.concatenate([np.zeros(0, np.int64)] + [c.flatten().to_numpy().astype(np.int64) for c in spans.column(i).chunks]) for i in ("docs", "starts", "ends"))
    by = np.lexsort((start, of))
    of, start, end = of[by], start[by], end[by]
    rows = docs.column("_row").to_numpy()
    lo, hi = np.searchsorted(of, rows), np.searchsorted(of, rows, "right")
    out: list[list] = [[], [], [], []]
    for i, text in enumerate(docs.column("_text")):
        raw = (text.as_py() or "").encode()
        kept, removed, runs, stop = [], 0, 0, 0
        for s, e in zip(start[lo[i]:hi[i]].tolist(), end[lo[i]:hi[i]].tolist()):
            if s > stop or not runs:  # a new run
                kept.append(raw[stop:s])
                removed, runs, stop = removed + e - s, runs + 1, e
            elif e > stop:
                removed, stop = removed + e - stop, e
        kept.append(raw[stop:])
        left = b"".join(kept)
        for into, v in zip(out, (len(raw), removed, runs, hashlib.sha256(left).hexdigest() if result == "kept_sha256" else left)):
            into.append(v)
    columns = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string() if result == "kept_sha256" else pa.binary()))]
    return pa.table([docs.column("_id"), *columns], ["_id", "n_bytes", "n_removed", "n_spans", result])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_only: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept (the bytes that stay; ``digest_only``: kept_sha256)."""
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    total = source.agg(F.sum(F.octet_length("_text")).alias("b"), F.count(F.lit(1)).alias("n"), F.count("_id").alias("ids")).first()
    whole = isinstance(source.schema["_id"].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    if whole and total["n"] == total["ids"] and source.groupBy("_id").count().where("count > 1").isEmpty():
        source = source.withColumn("_row", F.col("_id").cast("long"))
    else:  # ids that ascend with the sorted partitions
        source = written(source.orderBy(F.col("_id").isNull(), "_id", "_text").withColumn("_row", F.monotonically_increasing_id()), "numbered")
    size = total["b"] or 0
    least = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(least, -(-size // (35 * RANGE_SEGMENTS)))
    buckets = max(least, -(-size // RANGE_BYTES))
    texts = source.select("_row", "_text")

    sent = texts.mapInArrow(_send_segments(ranges), _SEGMENTS).repartition(ranges, "part")
    found = written(sent.mapInArrow(_classes(buckets), _SPANS), "segments")
    spans = found.where("NOT mixed")
    mixed = found.where("mixed").select("docs", "starts")
    n = mixed.agg(F.sum(F.size("docs"))).first()[0] or 0
    if n:
        bits = max(_BLOCK, 1 << (n * BLOOM_BITS - 1).bit_length())
        if bits // 8 <= BLOOM_BYTES:
            blocks = mixed.mapInArrow(_bloom_parts(bits), "block long, at binary").groupBy("block").applyInArrow(_bloom_block, "block long, bits binary")
            bloom = np.zeros((bits // _BLOCK, _BLOCK // 8), np.uint8)
            for r in written(blocks, "bloom").toLocalIterator():
                bloom[r["block"]] = np.frombuffer(r["bits"], np.uint8)
            picked = texts.mapInArrow(_send_bytes(ranges, bits, source.sparkSession.sparkContext.broadcast(bloom.reshape(-1))), _BYTES)
        else:
            at = mixed.select(F.explode(F.arrays_zip("docs", "starts")).alias("p")).groupBy(F.col("p.docs").alias("_r")).agg(F.collect_list("p.starts").alias("_at"))
            picked = texts.join(at, F.col("_row") == F.col("_r")).select("_row", "_text", "_at").mapInArrow(_send_bytes(ranges, bits, None), _BYTES)
        spans = spans.unionAll(written(picked.repartition(ranges, "part").mapInArrow(_resolve(buckets), _SPANS), "resolved"))
    return _apply(source, spans, buckets, id_col, digest_only)


def _apply(source: DataFrame, spans: DataFrame, buckets: int, id_col: str, digest_only: bool) -> DataFrame:
    r = F.col("_row")
    bucket = F.pmod(r.bitwiseXOR(F.shiftright(r, 7)).bitwiseXOR(F.shiftright(r, 17)), F.lit(buckets))
    kept = T.StructField("kept_sha256", T.StringType()) if digest_only else T.StructField("kept", T.BinaryType())
    schema = T.StructType([source.schema["_id"], *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), kept])
    left = source.withColumn("bucket", bucket).groupBy("bucket")
    out = left.cogroup(spans.select("bucket", "docs", "starts", "ends").groupBy("bucket")).applyInArrow(_cut_digest if digest_only else _cut, schema)
    return out.withColumnRenamed("_id", id_col)


def _bucket(row: np.ndarray, buckets: int) -> np.ndarray:
    return np.mod(row ^ (row >> 7) ^ (row >> 17), buckets)
