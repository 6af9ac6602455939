"""From documents to packed training sequences: every stage calls one operator of ``codesieve.llm``.

Each stage takes the documents that the one before it kept (read back from Parquet) and returns the
documents it keeps, with the columns of ``documents``; the last returns the packed pieces.

* quality: rejected documents go, failing lines go from those kept;
* simhash: one document of each near-duplicate group stays;
* secrets: every secret in a text is replaced by its kind in brackets;
* mixing: documents appear as often as their source's target asks for, rounded to whole documents;
* packing: one row per piece with its sequence and place.

Where a stage changes a text, ``n_chars`` follows it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.llm import mixing, packing, quality, secrets, simhash
from codesieve.llm.common import read_table, stored
from codesieve.session import ship_package

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _with_n_chars(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they now are; a null text has none."""
    if "n_chars" not in docs.columns:
        return docs
    kind = dict(docs.dtypes)["n_chars"]
    return docs.select(*[F.char_length("text").cast(kind).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return _with_n_chars(quality.keep_good(docs))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return simhash.keep_one(docs, shingle=3, max_bits=3)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_n_chars(secrets.redact(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs, weights=(3, 1, 2), share=1.5, max_repeat=2.0)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.pack_documents(docs, VOCABULARY)


STAGES = [
    ("quality", quality_stage),
    ("simhash", simhash_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

# token ids, fingerprints and line rules have no SQL form: tests hold the pipeline against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read back."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
