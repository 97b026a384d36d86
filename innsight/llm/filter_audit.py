"""Filter interaction audit: what every order of a set of filters removes, and at which step.

1. *Masks.*  A document is the set of filters it fails, one bit a filter.  The
   duplicate filter (identical to the text of any smaller id) compares digests:
   rows are pre-aggregated per (text, part, mask, labels), so that the copies of
   a text meet as a few rows whatever their number.
2. *Weights.*  Documents are summed per (part, mask): at most 32 rows a part
   with the documents, the good and the toxic ones.
3. *Ranks.*  The mask matrix (0 where a mask holds a filter, else infinite) and
   the inverse-permutation matrix (the step of each filter in each order) are
   combined by a min-plus product: the step at which each order removes each
   mask.  Scattering the weights to those steps gives the counts, and what a
   filter fails but an earlier step removed is redundant.

Defined results: a null text is empty; a null part is the empty string; a null
id equals no other, so it has no labels and no smaller id; rows that repeat an
id count one by one, and equal rows of the smallest id are no copies of each
other; of several labels of an id any positive one counts; empty tables give no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text that is not null."""
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def fail_masks(docs: DataFrame, labels: DataFrame, duplicate: str = "E", filters=text_filters, id_col: str = "doc_id",
               text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, docs, good, toxic): documents per part and set of failed filters.

    Bit ``i`` of ``mask`` is filter ``i`` of ``filters`` in alphabetical order, the
    ``duplicate`` filter included.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    fails = filters(text)
    letters = sorted([*fails, duplicate])
    bits = sum((F.when(fails[f], 1 << letters.index(f)).otherwise(0) for f in fails), F.lit(0))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
                       F.unhex(F.sha2(text, 256)).alias("digest"), bits.alias("mask"))
    marks = labels.select(F.col("doc_id").alias("id"), *[F.coalesce(F.col(c) == 1, F.lit(False)).cast("int").alias(c) for c in ("quality", "toxic")])
    marks = marks.groupBy("id").agg(F.max("quality").alias("good"), F.max("toxic").alias("toxic"))
    rows = rows.join(marks, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    kind = ["digest", "part", "mask", "good", "toxic"]
    rows = rows.groupBy("id", *kind).agg(F.count(F.lit(1)).alias("n"))
    known = F.col("id").isNotNull()
    rows = rows.groupBy(*kind).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("nameless"),
                                   F.min(F.when(known, F.struct("id", "n"))).alias("first"))
    least = F.min("first.id").over(Window.partitionBy("digest"))
    fresh = F.col("nameless") + F.when(F.col("first.id") == least, F.col("first.n")).otherwise(0)
    rows = rows.withColumn("fresh", fresh).select("part", "good", "toxic", F.inline(F.array(
        F.struct(F.col("mask"), F.col("fresh").alias("n")),
        F.struct((F.col("mask") + (1 << letters.index(duplicate))).alias("mask"), (F.col("n") - F.col("fresh")).alias("n")))))
    return rows.where("n > 0").groupBy("part", "mask").agg(
        F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def removal_ranks(orders: np.ndarray) -> np.ndarray:
    """Step (from 1) at which each order (rows: filter numbers) removes each mask; infinite where it keeps it: (masks, orders)."""
    n = orders.shape[1]
    held = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    masks = np.where(held == 1, 0.0, np.inf)
    steps = np.argsort(orders, axis=1).T + 1.0  # inverse permutations: step of filter f in order p
    return (masks[:, :, None] + steps[None]).min(axis=1)


def _scatter(weight: np.ndarray, orders: np.ndarray, ranks: np.ndarray) -> dict[str, np.ndarray]:
    """Counts per (order, step) from ``weight`` (documents, good, toxic per mask: three rows)."""
    p, n = orders.shape
    step = np.where(np.isfinite(ranks), ranks, n + 1).astype(np.int64) - 1
    cell = (np.arange(p)[None] * (n + 1) + step).ravel()  # of each (mask, order)
    lost = np.zeros((3, p * (n + 1)), np.int64)
    for into, w in zip(lost, weight):
        np.add.at(into, cell, np.repeat(w, p))
    lost = lost.reshape(3, p, n + 1)[:, :, :n]
    holds = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    fails = holds.T @ weight[0]  # documents failing each filter
    removed = lost[0]
    total = np.zeros(n, np.int64)
    np.add.at(total, orders, removed)
    return {"kept": weight[0].sum() - np.cumsum(removed, axis=1), "removed": removed, "redundant": fails[orders] - removed,
            "unique_fails": weight[0][1 << np.arange(n)][orders], "good_lost": lost[1], "toxic_lost": lost[2], "shapley": total[orders]}


def _audit(letters: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n = len(letters)
        orders = np.array(list(permutations(range(n))), np.int64)
        ranks = removal_ranks(orders)
        names = np.repeat(["".join(letters[f] for f in o) for o in orders], n)
        steps = np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders))
        for b in batches:
            for part, masks in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                weight = np.zeros((3, 1 << n), np.int64)
                for m in masks:
                    weight[:, m["mask"]] = m["docs"], m["good"], m["toxic"]
                counts = _scatter(weight, orders, ranks)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(steps), pa.string()), pa.array(names), pa.array(steps),
                                                  *[pa.array(counts[c].ravel()) for c in COUNTS]], ["part", "filter_order", "step", *COUNTS])

    return run


def audit(docs: DataFrame, labels: DataFrame, duplicate: str = "E", filters=text_filters, **columns: str) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    masks = fail_masks(docs, labels, duplicate, filters, **columns)
    letters = "".join(sorted([*filters(F.lit("")), duplicate]))
    per_part = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("masks"))  # 2 ** filters at most
    schema = T.StructType([T.StructField("part", T.StringType()), T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType()),
                           *[T.StructField(c, T.LongType()) for c in COUNTS]])
    return per_part.mapInArrow(_audit(letters), schema)

