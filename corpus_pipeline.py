"""A training corpus from raw documents: five stages, each written as Parquet and read again as the next one's documents.

All stages leave out rows without a doc_id, take a null text as empty and texts of any length whole, give no rows for an
empty table, and read the columns of documents only, whatever others there are. Nulls in lang, source and n_chars stay.
Rows that repeat a doc_id: all of them are scored, and kept or dropped each by its text (quality), with its group (exact
copies) or together (near-duplicates), passed together (mixing) and encoded each.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import sentencepiece
from tidemark.llm.common import discard, made, shared_dir, table
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.mixing import mix
from tidemark.llm.near_dedup import near_dedup
from tidemark.llm.quality_model import quality_model
from tidemark.llm.queries import SENTENCEPIECE_MODEL

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Most passes over a source; the largest one is passed once, so the mixture loses no document.
REPETITION_LIMIT = 1.25


def _columns(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; without labels of both kinds every score is 0.5, and none is."""
    scored = quality_model(docs, table(spark, sf_dir, "labels"), carry=COLUMNS[1:])
    return _columns(scored.where(F.col("predicted") == 1))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest doc_id."""
    return _columns(exact_dedup(docs, keep="largest", carry=COLUMNS[1:]).where("kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id."""
    return _columns(near_dedup(docs, carry=COLUMNS[1:]).where("kept"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: every document once, those of smaller sources again until their weights are met, in the order of their passes' permutations."""
    mixed = mix(docs, repetition_limit=REPETITION_LIMIT, cover=True, carry=("text", "lang", "n_chars"))
    return _columns(mixed.orderBy("progress", "doc_id", "epoch"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids of each document of the mixture, and whether they decode to its text."""
    decoded = sentencepiece.encode(docs, SENTENCEPIECE_MODEL, carry=("lang", "source"), column="decoded")
    return decoded.select("doc_id", "lang", "source", *sentencepiece.digest(decoded), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("minhash_near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: The classifier, the search for near-duplicates and the encoder have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The result of the last stage over the documents of sf_dir.

    Stages are written below folder (default: a new one in the shared folder), and the operators' own tables are deleted
    after each. A run that broke off goes on with the first unwritten stage when it is given the same folder again.
    """
    docs = table(spark, sf_dir, "documents")
    folder = folder or f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path, mark = f"{folder}/{i}-{name}", made()
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
            discard(spark, mark)
        docs = spark.read.parquet(path)
    return docs
