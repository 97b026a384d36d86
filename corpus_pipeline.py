"""The corpus pipeline: language ID, exact and near duplicates, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which
:func:`run` writes as Parquet to the shared checkpoint folder and rereads as the
next stage's documents.  All stages but the last return the columns of
``documents``; the last returns packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.llm.decontaminate import remove_contaminated
from innsight.llm.exact_dedup import exact_dedup
from innsight.llm.language_id import fit_dictionaries, keep_identified
from innsight.llm.ngram_join import keep_one_of_each_group
from innsight.llm.packing import pack, token_pieces
from innsight.llm.util import written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the dictionaries come from the labelled rows that are not held out."""
    learn = docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    return keep_identified(docs, fit_dictionaries(learn))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal normalised texts."""
    return exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_one_of_each_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 1024."""
    packed = pack(token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("ngram_join", near_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Compression and best-fit packing have no SQL form; tests hold run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
