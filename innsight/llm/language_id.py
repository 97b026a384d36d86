"""Language identification by compression.

:func:`fit_dictionaries` takes, per language, a bounded sample of labelled
texts as the raw content dictionary for zstandard.  :func:`identify` encodes
each whole text, reduced to its lower-case words, with every language's
dictionary and takes the language whose encoding is smallest.

The score is the margin over the second best language, less ``BLEND`` times what
the text would save if each of its blocks took its own best language: a text of
one language saves next to nothing, a text of two languages much.  A block counts
as saving ``MOST_SAVED`` of its size at most: more tells of a passage that stands in
a dictionary word for word, not of a language.  A text whose score is below
``MIN_SCORE`` is marked ``rejected``, whatever its length.  The parameters were
chosen so that clean texts stay (see the README for the shares measured).

The model is fitted on a bounded sample: the ``LANGUAGES`` most frequent labels,
``SAMPLE_ROWS`` rows of each, picked by a hash of the id; their whole texts are
cut into blocks of ``BLOCK_BYTES``, and the ``SAMPLE_BLOCKS`` distinct blocks with
the smallest hashes make a dictionary, as many of them as fit into ``DICT_BYTES``.
Texts are encoded in blocks of ``BLOCK_BYTES``, short ones in ``PARTS`` blocks, each
against the fresh dictionary, so that a long text's own words do not hide the
dictionary's; all blocks of a text count.  The work is text times languages.

Defined results: a null text, or one without a letter, is ``und`` with score 0
and rejected; with no labelled row at all every text is ``und``; equal sizes
go to the language with more labelled rows, with score 0, and are rejected; a
single language has margin 1/2; an empty table gives an empty result; other
columns pass through :func:`keep_identified` unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.llm.util import batches_of_bytes

LANGUAGES = 256
SAMPLE_ROWS = 400
SAMPLE_BLOCKS = 512
DICT_BYTES = 256 << 10
BLOCK_BYTES = 1024
PARTS = 4  # blocks of a text shorter than PARTS * BLOCK_BYTES ...
LEAST_BYTES = 64  # ... as far as they keep this length
LEVEL = 6
BLEND = 1.5
MOST_SAVED = 0.2
MIN_SCORE = 0.03
UNKNOWN = "und"


def fit_dictionaries(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Per language, the most frequent first, a raw dictionary from a bounded sample of ``labelled``."""
    from pyspark.sql import Window

    rows = labelled.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text")).where("_lang IS NOT NULL AND _text IS NOT NULL")
    counts = rows.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(LANGUAGES)
    often = {r["_lang"]: r["count"] for r in counts.collect()}  # at most LANGUAGES rows
    if not often:
        return {}
    # Hashes below these bounds belong to twice the sample's rows at least (about): only they meet in a window.
    bounds = F.create_map(*[F.lit(x) for lang, n in often.items() for x in (lang, min((1 << 63) - 1, -(1 << 63) + (SAMPLE_ROWS << 65) // n))])
    few = rows.where(F.xxhash64("_id") <= F.try_element_at(bounds, F.col("_lang")))
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), F.col("_id"), F.xxhash64("_text"))
    sample = few.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= SAMPLE_ROWS).select("_lang", "_text")

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches_of_bytes(batches, "_text"):
            langs, blocks = [], []
            for lang, text in zip(b.column("_lang").to_pylist(), b.column("_text").to_pylist()):
                found = _blocks(_letters(text).strip(), BLOCK_BYTES)
                langs += [lang] * len(found)
                blocks += found
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(blocks, pa.binary())], ["_lang", "_block"])

    blocks = sample.mapInArrow(cut, "_lang string, _block binary").distinct()
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_block"), F.col("_block"))
    blocks = blocks.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= SAMPLE_BLOCKS)
    out: dict[str, bytes] = {}
    for r in sorted(blocks.collect(), key=lambda r: (-often[r["_lang"]], r["_lang"], r["_n"])):  # at most SAMPLE_BLOCKS x BLOCK_BYTES a language
        joined = b" ".join([out[r["_lang"]], bytes(r["_block"])]) if r["_lang"] in out else bytes(r["_block"])
        if len(joined) <= DICT_BYTES:
            out[r["_lang"]] = joined
    return out


_GAP = re.compile(r"[\W\d_]+")


def _letters(text: str) -> bytes:
    """Lower-case words only: case, digits and punctuation say little about the language."""
    return _GAP.sub(" ", text.lower()).encode()


def _blocks(raw: bytes, length: int) -> list[bytes]:
    return [raw[i:i + length] for i in range(0, len(raw), length)]


def _compressors(dictionaries: dict[str, bytes]):
    import zstandard as zstd

    out = []
    for lang, raw in dictionaries.items():
        d = zstd.ZstdCompressionDict(raw.ljust(8), dict_type=zstd.DICT_TYPE_RAWCONTENT)  # 8 bytes: zstandard's least content
        d.precompute_compress(level=LEVEL)
        out.append((lang, zstd.ZstdCompressor(dict_data=d, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False).compress))
    return out


def _score(raw: bytes, languages: list) -> tuple[int, float]:
    """(the language with the smallest encoding of all blocks, its score)."""
    blocks = _blocks(raw, min(BLOCK_BYTES, max(LEAST_BYTES, -(-len(raw) // PARTS))))
    sizes = [[len(compress(block)) for block in blocks] for _, compress in languages]
    totals = [sum(s) for s in sizes]
    best = min(range(len(totals)), key=totals.__getitem__)
    second = min((t for i, t in enumerate(totals) if i != best), default=2 * totals[best])
    saved = sum(min(own - min(each), MOST_SAVED * own) for own, each in zip(sizes[best], zip(*sizes)))
    return best, max(0.0, (second - totals[best]) / second - BLEND * saved / totals[best])


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) plus lang_pred, score (0 to 1), rejected."""
    names = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # bounded: DICT_BYTES a language

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import regex

        languages = _compressors(shared.value)
        letter = regex.compile(r"\p{L}")
        for b in batches_of_bytes(batches, "_text"):
            pred, score, rejected = [], [], []
            for cell in b.column(b.num_columns - 1):
                text = cell.as_py()
                if text is None or not languages or not letter.search(text):
                    pred.append(UNKNOWN), score.append(0.0), rejected.append(True)
                    continue
                raw = _letters(text)
                best, value = _score(raw, languages)
                pred.append(languages[best][0]), score.append(value), rejected.append(value < MIN_SCORE)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                                             [*b.schema.names[:-1], "_pred", "_score", "_rejected"])

    safe = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(f"`{text_col}`").alias("_text"))
    schema = T.StructType([*safe.schema.fields[:-1], T.StructField("_pred", T.StringType()), T.StructField("_score", T.DoubleType()), T.StructField("_rejected", T.BooleanType())])
    out = safe.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("_pred").alias("lang_pred"), F.col("_score").alias("score"), F.col("_rejected").alias("rejected"))


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is identified, columns unchanged."""
    safe = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    found = identify(safe, dictionaries, f"c{docs.columns.index(text_col)}").where("NOT rejected")
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
