"""A corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

quality classifier -> SimHash near-dedup -> substring dedup -> benchmark decontamination -> BPE.
All stages but the last return the columns of ``documents`` (and any others that the input has).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, decontaminate, quality, simhash_dedup, substring_dedup
from quillspark.llm.labelled import crc_fold
from quillspark.llm.storage import materialise


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects (score under 0.5); it learns from the rows not held out."""
    model = quality.train(docs, _table(spark, sf_dir, "labels"), ~crc_fold(F.col("doc_id"), 3, 1))
    return docs.filter(quality.scores(docs, model) >= 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each class of near-duplicates."""
    return simhash_dedup.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every word of a repeated 35-word window; the rest is joined by single spaces.

    A document stays even if no word of it does.  One without a repeated window keeps its text as it is.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = substring_dedup.remove_repeated(docs, carry=["text", *others] + ["n_chars"] * ("n_chars" in docs.columns))
    touched = F.col("n_removed") > 0
    text = F.when(touched, F.col("kept")).otherwise(F.col("text"))
    made = {"doc_id": F.col("doc"), "text": text, "n_chars": F.when(touched, F.length("kept").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return cut.select(*(made[c].alias(c) if c in made else F.col(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a window that matches a benchmark item."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids)."""
    return bpe.encode(docs).withColumnRenamed("doc", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("bpe", encode_tokens),
]

#: Classifier, fingerprints and BPE are beyond SQL; tests/llm hold every stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; results between them are written to the shared folder and read again.

    Null and empty texts pass every stage that their score and class let them pass, and end with no tokens; of classes,
    the least id stays (null ids last); repeated rows are one class; a null id stays null; an empty table gives none.
    """
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
