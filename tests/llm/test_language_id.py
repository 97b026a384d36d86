import random
import string

from pyspark.sql import functions as F

from innsight.llm import language_id as li
from innsight.llm.queries import op9_language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = op9_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id")
    r = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.avg(F.col("rejected").cast("int")).alias("r"),
                                    F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r.a >= 0.97 and r.r <= 0.02 and r.lo >= 0 and r.hi <= 1
    assert {x[0] for x in found.select("lang_pred").distinct().collect()} <= {"en", "de", "fr", "es", "und"}


def test_training_reads_no_held_out_row(spark, docs_of):
    rows = [(1, "uno dos tres cuatro", "es"), (2, "one two three four", "en"), (3, "un deux trois", None), (4, None, "fr")]
    got = li.fit_dictionaries(docs_of(rows, "doc_id long, text string, lang string"))
    assert sorted(got) == ["en", "es"] and got["en"] == b"one two three four"


def test_sample_is_bounded_and_takes_whole_texts(docs_of, monkeypatch):
    rows = [(i, f"word{chr(97 + i)} " * 400 + "end" + chr(97 + i), "x") for i in range(20)]
    whole = li.fit_dictionaries(docs_of(rows, "doc_id long, text string, lang string"))["x"]
    assert all(f"end{chr(97 + i)}".encode() in whole for i in range(20))  # the ends of the texts count as well
    monkeypatch.setattr(li, "SAMPLE_ROWS", 3)
    monkeypatch.setattr(li, "DICT_BYTES", 5000)
    got = li.fit_dictionaries(docs_of(rows, "doc_id long, text string, lang string"))["x"]
    assert 0 < len(got) <= 5000 and len({w for w in got.split() if w.startswith(b"word")}) <= 5
    monkeypatch.setattr(li, "LANGUAGES", 2)
    many = [(i, "abc def", lang) for i, lang in enumerate(["p", "p", "q", "q", "r", "s"])]
    assert list(li.fit_dictionaries(docs_of(many, "doc_id long, text string, lang string"))) == ["p", "q"]


def test_nonsense_and_mixed_texts_are_rejected_and_clean_ones_kept(spark, docs_of):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text IS NOT NULL AND lang IS NOT NULL")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    d = li.fit_dictionaries(docs.where(~held))
    by: dict[str, list[str]] = {}
    for r in docs.where(held & (F.length("text") >= 400)).orderBy("doc_id").collect():
        by.setdefault(r.lang, []).append(r.text)
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate([t for texts in by.values() for t in texts[:100]])]
    clean = len(rows)
    for _ in range(300):
        a, b = rng.sample(sorted(by), 2)
        x, y = rng.choice(by[a]).split(), rng.choice(by[b]).split()
        n = min(len(x), len(y))
        rows.append((len(rows), " ".join(x[:n] + y[:n])))
    mixed = len(rows)
    for _ in range(300):
        rows.append((len(rows), " ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 9))) for _ in range(rng.randint(30, 300)))))
    gone = {r.doc_id for r in li.identify(docs_of(rows), d).where("rejected").collect()}
    share = lambda lo, hi: sum(lo <= i < hi for i in gone) / (hi - lo)
    assert share(0, clean) <= 0.02 and share(clean, mixed) >= 0.75 and share(mixed, len(rows)) >= 0.98


def test_predictions_equal_a_plain_version(docs_of):
    import zstandard

    rng = random.Random(9)
    words = {"aa": ["alpha", "beta", "gamma", "delta"], "bb": ["uno", "dos", "tres", "cuatro"], "cc": ["xyz"]}
    d = {lang: " ".join(rng.choices(w, k=300)).encode() for lang, w in words.items()}
    rows = [(i, " ".join(rng.choice(words[rng.choice(langs)]) for _ in range(rng.choice([1, 5, 40, 900])))) for i, langs in enumerate([["aa"], ["bb"], ["aa", "bb"], ["aa", "cc"]] * 10)]
    got = {r.doc_id: r for r in li.identify(docs_of(rows), d).collect()}
    tools = {}
    for lang, raw in d.items():
        known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        tools[lang] = zstandard.ZstdCompressor(dict_data=known, level=6, write_checksum=False, write_content_size=False, write_dict_id=False)
    for i, text in rows:
        raw = text.encode()  # lower-case words and single blanks already
        step = 1024 if len(raw) > 4096 else max(64, (len(raw) + 3) // 4)
        table = [[len(tools[lang].compress(raw[k:k + step])) for k in range(0, len(raw), step)] for lang in d]
        totals = sorted((sum(t), k) for k, t in enumerate(table))
        (best, k), (second, _) = totals[:2]
        saved = sum(min(own - min(each), own / 5) for own, each in zip(table[k], zip(*table)))
        value = max(0.0, (second - best) / second - 1.5 * saved / best)
        assert got[i].lang_pred == list(d)[k] and abs(got[i].score - value) < 1e-12 and got[i].rejected == (value < 0.03)


def test_odd_documents(docs_of, odd_docs):
    d = {"en": b"the one two and word tail " * 20, "fr": "été le la les une deux ".encode() * 20}
    docs = docs_of(odd_docs).withColumn("_text", F.lit("clash")).withColumn("lang_pred", F.lit("old"))
    got = {(r.doc_id, r._2): r for r in [type("R", (), {"doc_id": r.doc_id, "_2": r.text, "p": r["lang_pred"], "s": r.score, "x": r.rejected})
                                         for r in li.identify(docs, d, keep=["doc_id", "text"]).collect()]}
    for (i, t), r in got.items():
        if t is None or not t.strip():
            assert (r.p, r.s, r.x) == ("und", 0.0, True)
        else:
            assert r.p in d and 0 <= r.s <= 1
    assert got[(9, "été " * 50)].p == "fr"
    kept = li.keep_identified(docs, d)
    assert kept.columns == docs.columns and kept.where("trim(coalesce(text, '')) = ''").count() == 0
    assert li.identify(docs_of([]), d).collect() == [] and {r.lang_pred for r in li.identify(docs_of(odd_docs), {}).collect()} == {"und"}


def test_narrow_margins_are_rejected(docs_of):
    same = b"alpha beta gamma delta " * 30
    r = li.identify(docs_of([(1, "alpha beta gamma delta " * 20), (2, "short")]), {"b": same, "a": same}).collect()
    assert {x.doc_id: (x.lang_pred, x.score, x.rejected) for x in r} == {1: ("b", 0.0, True), 2: ("b", 0.0, True)}
