import re
from collections import defaultdict

import corpus_pipeline as cp
from .test_decontaminate import brute as contaminated
from .test_exact_dedup import sha
from .test_ngram_join import brute as near
from .test_packing import reference_pieces

SF = "/root/testdata/sf0.001"


def test_stages_equal_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = {}
    for name, stage in cp.STAGES:
        before = docs if name == "packing" else None
        docs = cp.written(stage(spark, docs, SF), name)
        if name != "packing":
            assert docs.columns == columns
            rows[name] = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    identified = rows["language_id"]
    assert len(identified) >= 0.98 * spark.read.parquet(f"{SF}/documents.parquet").count()
    groups = defaultdict(list)
    for i, t in identified:
        groups[sha(t)].append((i, t))
    assert rows["exact_dedup"] == sorted(min(g) for g in groups.values())
    own = {(i, c) for i, _, c in near(rows["exact_dedup"])}
    stay = {i for i, c in own if i == c or c is None}
    assert rows["ngram_join"] == [r for r in rows["exact_dedup"] if r[0] in stay]
    out = {d for d, _ in contaminated(rows["ngram_join"], items)}
    assert rows["decontamination"] == [r for r in rows["ngram_join"] if r[0] not in out]
    got = sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in docs.collect()), key=str)
    assert got == reference_pieces(rows["decontamination"]) and before.count() == len(rows["decontamination"])


def test_run_and_entry(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14))
    assert set(entry.oracle_sql()) <= names
    assert cp.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
