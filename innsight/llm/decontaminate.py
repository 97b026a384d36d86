"""Benchmark decontamination: short test items found inside long documents.

Native DataFrame functions only.  Texts become lower-case words (runs of
letters and digits) and hashed five-word shingles.  Jaccard MinHash fails here,
as an item's few shingles drown in a long document, so the search is one-sided.
In place of size-partitioned MinHash, which would miss some items near the
threshold, a lossless prefix filter is used: an item of ``m`` distinct shingles
is keyed by its ``k = m - ceil(0.8 m) + 1`` smallest shingle hashes.  A document that contains 80 % of an item's shingles must hold one of
any ``k`` of them, so probing every shingle of every document against
those misses nothing.  Candidate pairs are then verified by the exact
containment of the item's shingles in the document.

The item side is broadcast when its counted rows are at most ``BROADCAST_ROWS``
(24 bytes each); otherwise it is joined by shuffle, with adaptive skew handling.
Candidates are narrow (document, item) rows; documents' texts are never
shuffled.

Defined results: null or empty texts hold nothing; an item of fewer than five
words is one shingle of its own length, looked for among the documents'
shingles of that length; an item without words is found nowhere; rows that
share an id (null included) count as one document; repeated items count once;
empty tables give empty results; other columns pass through
:func:`remove_contaminated` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.llm.util import written

WORDS = 5
PERCENT = 80
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(word_list: Column, n: int) -> Column:
    """Hashes of the ``n``-word shingles of a word list (with repeats)."""
    hashed = F.array(F.transform(word_list, lambda w: F.xxhash64(w)))
    # The outer one-element array binds the hashed words once for the inner function.
    return F.transform(hashed, lambda h: F.when(
        F.size(h) >= n, F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))
    ).otherwise(F.array().cast("array<bigint>")))[0]


def _item_shingles(items: DataFrame, item_id: str, text_col: str) -> DataFrame:
    """_item, item_id, _n (words a shingle), _m, _s, _signed: one row per distinct shingle of an item."""
    rows = items.select(F.col(item_id).alias("item_id"), F.col(text_col).alias("_text")).dropDuplicates()
    rows = rows.withColumn("_w", words(F.col("_text"))).withColumn("_n", F.least(F.size("_w"), F.lit(WORDS))).where("_n > 0")
    by_size = F.when(F.col("_n") == WORDS, shingles(F.col("_w"), WORDS))
    for n in range(1, WORDS):
        by_size = by_size.when(F.col("_n") == n, shingles(F.col("_w"), n))
    rows = rows.withColumn("_set", F.array_sort(F.array_distinct(by_size))).withColumn("_m", F.size("_set"))
    k = F.col("_m") - F.ceil(F.col("_m") * PERCENT / 100) + 1
    rows = rows.withColumn("_item", F.monotonically_increasing_id())
    return rows.select("_item", "item_id", "_n", "_m", k.alias("_k"), F.posexplode("_set").alias("_at", "_s")).select(
        "_item", "item_id", "_n", "_m", "_s", (F.col("_at") < F.col("_k")).alias("_signed"))


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(``id_col``, item_id, item_shingles, shared, containment) for every document that contains 80 % of an item."""
    known = written(_item_shingles(items, item_id, item_text), "items")
    sizes = sorted(r["_n"] for r in known.select("_n").distinct().collect())  # at most WORDS values
    small = known.count() <= BROADCAST_ROWS
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def probe(rows: DataFrame, side: DataFrame, *more: str) -> DataFrame:
        """Rows of ``rows`` and ``side`` that share a shingle."""
        side = side.select("_n", "_s", "_item", *more)
        exploded = None
        for n in sizes or [WORDS]:
            one = rows.select("_id", F.lit(n).alias("_n"), F.explode(shingles(words(F.col("_text")), n)).alias("_s"))
            exploded = one if exploded is None else exploded.unionAll(one)
        return exploded.join(F.broadcast(side) if small else side, ["_n", "_s"])

    candidates = written(probe(source, known.where("_signed")).select("_id", "_item").distinct(), "candidates")
    ids = candidates.select(F.col("_id").alias("_c")).distinct()
    if ids.count() <= BROADCAST_ROWS:  # else every document is looked at again
        source = source.join(F.broadcast(ids), F.col("_id").eqNullSafe(F.col("_c")), "left_semi")
    shared = probe(source, known, "item_id", "_m").alias("p").join(
        candidates.alias("c"), F.col("p._id").eqNullSafe(F.col("c._id")) & (F.col("p._item") == F.col("c._item")), "left_semi")
    found = shared.groupBy("_id", "_item", "item_id", "_m").agg(F.count_distinct("_s").alias("shared")).where(F.col("shared") * 100 >= F.col("_m") * PERCENT)
    found = found.groupBy("_id", "item_id").agg(F.max(F.struct((F.col("shared") / F.col("_m")).alias("c"), F.col("_m").alias("m"), F.col("shared").alias("n"))).alias("b"))
    return found.select(F.col("_id").alias(id_col), "item_id", F.col("b.m").cast("long").alias("item_shingles"), F.col("b.n").alias("shared"), F.col("b.c").alias("containment"))


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found, columns unchanged."""
    hit = find_items(docs, items, id_col, text_col, item_id, item_text).select(F.col(id_col).alias("_hit")).distinct()
    hit = written(hit, "contaminated")
    names = docs.columns
    safe = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    own = F.col(f"c{names.index(id_col)}")
    hit = F.broadcast(hit) if hit.count() <= BROADCAST_ROWS else hit
    kept = safe.join(hit, own.eqNullSafe(F.col("_hit")), "left_anti")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
