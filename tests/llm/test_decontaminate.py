import random
import re

from pyspark.sql import functions as F

from innsight.llm import decontaminate as dc


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items):
    out = set()
    for item, q in set(items):
        n = min(5, len(words(q)))
        if not n:
            continue
        want = {tuple(words(q)[i:i + n]) for i in range(len(words(q)) - n + 1)}
        for i in {d for d, _ in docs}:
            have = set()
            for d, t in docs:
                if d == i:
                    w = words(t)
                    have |= {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}
            if 100 * len(want & have) >= 80 * len(want):
                out.add((i, item))
    return out


def test_equals_brute_force(docs_of):
    rng = random.Random(5)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(n))) for k, n in enumerate([1, 3, 5, 6, 9, 14, 20, 40, 59])] + [(50, "tiny"), (51, ""), (52, None), (None, "null item of six whole words")]
    docs = []
    for d in range(60):
        text = [f"d{d}x{j}" for j in range(rng.randrange(0, 200))]
        for _ in range(rng.randrange(0, 3)):
            k = rng.randrange(9)
            part = items[k][1].upper().split(" ")
            for _ in range(rng.randrange(0, 1 + len(part) // 8)):
                part[rng.randrange(len(part))] = "changed"
            at = rng.randrange(len(text) + 1)
            text[at:at] = part
        docs.append((d, ", ".join(text)))
    docs += [(3, "tiny"), (None, "a null item of six whole words here"), (61, None), (62, "")]
    found = dc.find_items(docs_of(docs), docs_of(items + items[:2], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == brute(docs, items)
    assert found.groupBy("doc_id", "item_id").count().where("count > 1").count() == 0


def test_shuffled_sides_agree(docs_of, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 0)
    docs = [(i, "lead in " + " ".join(f"q{j}" for j in range(12 if i % 2 else 8))) for i in range(20)]
    found = dc.find_items(docs_of(docs), docs_of([(1, " ".join(f"q{j}" for j in range(12)))], "item_id long, text string"))
    assert sorted(r.doc_id for r in found.collect()) == list(range(1, 20, 2))


def test_clean_rows_stay_with_all_columns(docs_of, odd_docs):
    docs = docs_of(odd_docs).withColumn("_id", F.lit(3)).withColumn("c1", F.lit("x"))
    items = docs_of([(1, "word5 tail5 word6 tail6 word7 tail7 word8")], "item_id long, text string")
    kept = dc.remove_contaminated(docs, items)
    assert kept.columns == ["doc_id", "text", "_id", "c1"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, _ in odd_docs if i not in (6, 7)), key=str)
    none = docs_of([], "item_id long, text string")
    assert dc.remove_contaminated(docs, none).count() == len(odd_docs)
    assert dc.find_items(docs_of([]), items).collect() == []


def test_no_python_runs(spark):
    from conftest import plan_text

    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    for df in (dc.find_items(docs, items), dc.remove_contaminated(docs, items)):
        assert not re.search("Python|Pandas|Arrow", plan_text(df))
