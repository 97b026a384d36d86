"""WARC archives of crawled pages, and a merged index of their captures.

:func:`write_archives` turns each page into a WARC/1.0 record.  Of pages with
equal payloads (SHA-256, at least ``MIN_REVISIT`` bytes) the one with the
smallest id is stored as a response, the others as revisits of it.  A record is
text (headers, HTTP head, UTF-8 payload), so Spark's text writer with the WARC
record separator as line separator writes well-formed archives to any file
system Spark reaches.  Files are small: pages are written by size class, each
with its own number of records a file (``CLASSES``), so that one file fits a task's
memory whatever the page sizes.

:func:`read_archives` parses records by their Content-Length (payloads may hold
anything, separators included) and checks digests; it reads any archive of this
kind.  It emits each file's captures sorted by (URL key, timestamp, page): a run.

:func:`capture_index` range-partitions the runs by that key and merges, in each
partition, its k runs with a loser tree; partitions and positions give the
global order of capture histories.  Ranges include the timestamp and page, so
the captures of one hot URL spread over partitions.

Defined results: null html is an empty payload; null URLs have an empty URL key
and come first; null ids are kept (a null id is a response only where no row
with that payload has an id); rows that repeat a page are records of their own;
empty tables give empty archives and an empty index; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.llm.util import scratch_path

MIN_REVISIT = 100
CLASSES = ((16 << 10, 1000), (256 << 10, 100), (8 << 20, 4), (None, 1))  # payload bytes below, records a file
BROADCAST_ROWS = 500_000
END = "\r\n\r\n"
CAPTURES = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, "
            "captured_at string, archive string, record_offset long, record_length long")


def _record(kind: Column, first: Column) -> Column:
    """Text of a WARC record without its closing separator."""
    uri = F.regexp_replace(F.regexp_replace(F.col("_url"), "\r", "%0D"), "\n", "%0A")
    digest = F.concat(F.lit("sha256:"), F.col("_digest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_bytes").cast("string"), F.lit(END))

    def header(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise(F.lit(""))

    common = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), kind, F.lit("\r\n"),
        F.lit("WARC-Record-ID: <urn:uuid:"), F.col("_uuid"), F.lit(">\r\n"), header("WARC-Date", F.col("_date")), header("WARC-Target-URI", uri),
        header("WARC-Payload-Digest", digest), header("WARC-Page-Id", F.col("_id")), header("WARC-Payload-Length", F.col("_bytes")))
    response = F.concat(common, F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
                        (F.octet_length(http) + F.col("_bytes")).cast("string"), F.lit(END), http, F.col("_payload"))
    revisit = F.concat(common, header("WARC-Refers-To-Page", first), F.lit(
        "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nContent-Length: 0"), F.lit(END))
    return F.when(kind == "response", response).otherwise(revisit)


def write_archives(pages: DataFrame, folder: str, captured_at: Column, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write one record per row of ``pages`` below ``folder``.  ``captured_at``: ISO text, an expression over ``pages``."""
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"), F.coalesce(F.col(html_col), F.lit("")).alias("_payload"), captured_at.alias("_date"))
    rows = rows.withColumn("_digest", F.sha2("_payload", 256)).withColumn("_bytes", F.octet_length("_payload").cast("long"))
    name = F.sha2(F.concat_ws("|", "_id", "_url", "_date", "_digest"), 256)
    rows = rows.withColumn("_uuid", F.concat_ws("-", *[F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))
    repeated = rows.where(F.col("_bytes") >= MIN_REVISIT).groupBy("_digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"), F.first("_bytes").alias("_b")).where("_n > 1")
    classes = {r["c"] for r in rows.groupBy(_size_class(F.col("_bytes")).alias("c")).count().collect()}
    first = repeated.select(F.col("_digest").alias("_d"), "_first")
    first = F.broadcast(first) if repeated.count() <= BROADCAST_ROWS else first
    rows = rows.join(first, F.col("_digest") == F.col("_d"), "left")
    kind = F.when(F.col("_first").isNull() | F.col("_id").eqNullSafe(F.col("_first")), "response").otherwise("revisit")
    for c, (_, records) in enumerate(CLASSES):
        if c in classes:
            some = rows.where(_size_class(F.col("_bytes")) == c).select(_record(kind, F.col("_first")))
            some.write.option("lineSep", END).option("maxRecordsPerFile", records).text(f"{folder}/class={c}")


def _size_class(n: Column) -> Column:
    out = None
    for c, (below, _) in enumerate(CLASSES[:-1]):
        out = F.when(n < below, c) if out is None else out.when(n < below, c)
    return out.otherwise(len(CLASSES) - 1)


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels reversed, then path and query, lower case."""
    m = re.match(r"(?s)^.*?://([^/?#]*)([^#]*)", url or "")
    if not m:
        return (url or "").lower()
    return f"{','.join(reversed(m[1].lower().split('.')))}){m[2].lower()}"


def parse_records(data) -> Iterator[tuple[dict[str, str], int, int, int]]:
    """(headers, block start, block end, record start) of each record of an archive."""
    at, n = 0, len(data)
    while at < n:
        start = at
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0 or data[at:at + 10] != b"WARC/1.0\r\n":
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(line.split(": ", 1) for line in data[at + 10:stop].decode().split("\r\n") if ": " in line)
        block = stop + 4
        at = block + int(headers["Content-Length"])
        if data[at:at + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {start} is cut short")
        yield headers, block, at, start
        at += 4


def _captures(archive: str, data: bytes) -> list[tuple]:
    out = []
    for h, block, end, start in parse_records(data):
        digest = h["WARC-Payload-Digest"].partition(":")[2]
        if h["WARC-Type"] == "response":
            payload = data[data.find(b"\r\n\r\n", block) + 4:end]
            size = len(payload)
            if hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"{archive}: payload of the record at byte {start} is damaged")
        else:
            size = int(h["WARC-Payload-Length"])
        page, refers = h.get("WARC-Page-Id"), h.get("WARC-Refers-To-Page")
        out.append((page and int(page), size, digest, h["WARC-Type"], refers and int(refers), url_key(h.get("WARC-Target-URI")),
                    h.get("WARC-Date"), archive, start, end + 4 - start))
    return sorted(out, key=_order)


def _order(c) -> tuple:
    return (c[5], c[6] or "", c[0] is not None, c[0] or 0, c[7], c[8])


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record below ``folder``, each file's in the order of the index."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [f.split()[0] for f in CAPTURES.split(", ")]
        types = [pa.int64() if f.split()[1] == "long" else pa.string() for f in CAPTURES.split(", ")]
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                found = _captures(path.as_py(), content.as_py())
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(folder)
    return files.where("length > 0").select("path", "content").mapInArrow(run, CAPTURES)


class LoserTree:
    """K-way merge of sorted runs: each step replays one path of matches."""

    def __init__(self, runs: list[list], key):
        self._runs, self._key = [iter(r) for r in runs], key
        k = 1
        while k < len(runs):
            k *= 2
        self._k = k
        self._head = [self._next(i) for i in range(k)]
        self._lost = [0] * k  # the loser of the match at each inner node
        winner = [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], self._lost[node] = (a, b) if self._beats(a, b) else (b, a)
        self._top = winner[1] if k > 1 else 0

    def _next(self, i: int):
        item = next(self._runs[i], None) if i < len(self._runs) else None
        return None if item is None else (self._key(item), i, item)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._head[a], self._head[b]
        return y is None or x is not None and x[:2] < y[:2]

    def __iter__(self) -> Iterator:
        while self._head[self._top] is not None:
            i = self._top
            yield self._head[i][2]
            self._head[i] = self._next(i)
            node = (i + self._k) // 2
            while node:
                if self._beats(self._lost[node], i):
                    i, self._lost[node] = self._lost[node], i
                node //= 2
            self._top = i


def capture_index(captures: DataFrame, partitions: int | None = None) -> DataFrame:
    """``captures`` in the global order of (URL key, timestamp, page): plus index_part, index_position."""
    names = captures.columns

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        runs: dict[str, list] = {}
        schema = None
        for b in batches:
            schema = b.schema
            for row in zip(*(c.to_pylist() for c in b.columns)):
                runs.setdefault(row[7], []).append(row)
        if not runs:
            return
        for r in runs.values():  # a run keeps its order on the way here; if not, it is mended
            if any(_order(a) > _order(b) for a, b in zip(r, r[1:])):
                r.sort(key=_order)
        part, done, pending = TaskContext.get().partitionId(), 0, []

        def batch(rows):
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), schema.types)]
            return pa.RecordBatch.from_arrays([*cols, pa.array([part] * len(rows), pa.int32()), pa.array(range(done, done + len(rows)), pa.int64())],
                                              [*names, "index_part", "index_position"])

        for row in LoserTree(list(runs.values()), _order):
            pending.append(row)
            if len(pending) == 10_000:
                yield batch(pending)
                done, pending = done + len(pending), []
        if pending:
            yield batch(pending)

    keys = [F.col("url_key"), F.col("captured_at"), F.col("page_id"), F.col("archive"), F.col("record_offset")]
    dealt = captures.repartitionByRange(partitions, *keys) if partitions else captures.repartitionByRange(*keys)
    return dealt.mapInArrow(run, f"{CAPTURES}, index_part int, index_position long")


def archive_pages(pages: DataFrame, folder: str | None = None, captured_at: Column | None = None) -> DataFrame:
    """Write ``pages`` as archives (to a scratch folder by default), read them back, and index the captures."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    if captured_at is None:  # a crawl second per page
        captured_at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.coalesce(F.col("page_id"), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    write_archives(pages, folder, captured_at)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], f"{CAPTURES}, index_part int, index_position long")
    return capture_index(read_archives(spark, folder))
