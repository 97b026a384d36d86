import hashlib
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from innsight.llm import exact_dedup as ed
from innsight.llm.queries import oracle_sql, queries


def sha(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[sha(t)].append(i)
    out = []
    for h, ids in groups.items():
        ids.sort(key=lambda x: (x is None, x or 0))
        out += [(i, ids[0], len(ids), k == 0, h) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def rows_with_copies():
    return [(i, f"text {i % 700}" + " \t" * (i % 3) + "end") for i in range(900)] + [(i, "hot") for i in range(1000, 1600)]


def test_groups_equal_brute_force(docs_of, odd_docs):
    for rows in (odd_docs, rows_with_copies()):
        assert sorted(map(tuple, ed.exact_groups(docs_of(rows)).collect()), key=str) == brute(rows)
    assert ed.exact_groups(docs_of([])).collect() == []


def test_several_segments_and_blocks(docs_of, monkeypatch):
    """A filter cut into many segments, tested in several blocks, decides the same."""
    monkeypatch.setattr(ed, "BITS_PER_ROW", 6000)
    monkeypatch.setattr(ed, "BLOCK_BYTES", ed.SEGMENT_BITS // 8 * 2)
    rows = rows_with_copies()
    assert ed._segments(len(rows)) > 4
    assert sorted(map(tuple, ed.exact_groups(docs_of(rows)).collect()), key=str) == brute(rows)


def test_only_possible_repeats_are_flagged(docs_of):
    prints = docs_of([(i, f"t{i}") for i in range(5000)] + [(9999, "t7")]).select(F.col("doc_id").alias("_id"), ed.normalised_sha256(F.col("text")).alias("_sha"))
    flagged = ed.flag_repeats(prints, prints, 5001).where("_maybe")
    ids = {r._id for r in flagged.collect()}
    assert {7, 9999} <= ids and len(ids) < 50


def test_kept_rows_pass_with_all_columns(docs_of, odd_docs):
    docs = docs_of(odd_docs).select("doc_id", F.col("text"), F.lit("x").alias("_sha"), F.lit(2).alias("c0"))
    kept = ed.exact_dedup(docs)
    assert kept.columns == ["doc_id", "text", "_sha", "c0"]
    got = sorted(((r.doc_id, sha(r.text)) for r in kept.collect()), key=str)
    assert got == sorted(((i, h) for i, _, _, k, h in brute(odd_docs) if k), key=str)


@pytest.mark.parametrize("key", sorted(oracle_sql()))
def test_query_matches_sql(spark, key):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    rel = con.sql(oracle_sql()[key])
    df = queries()[key](spark, sf)
    assert sorted(df.columns) == sorted(rel.columns)
    got = sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)
    order = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert got == sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=str)
