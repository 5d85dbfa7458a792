"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_fold(id_col: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in ``fold``; a null id is in none."""
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == fold, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, most: int, balanced: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, label 0/1, text): at most ``most`` labelled ids (of each label, if balanced) that ``usable`` admits.

    Ids are taken in the order of their hashes, so the sample is the same on every run.  Ids or labels that are
    null, and labels other than 0 and 1, are passed over; of several labels of one id the largest counts, of
    several texts the least.  The ids, ``2 * most`` rows at most, are broadcast.
    """
    label = F.col(label_col).cast("int")
    known = labels.filter(usable & F.col(id_col).isNotNull() & label.isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("doc")).agg(F.max(label).alias("label"))
    order = [F.xxhash64("doc"), F.col("doc")]
    if balanced:
        picked = known.filter("label = 0").orderBy(*order).limit(most).unionByName(known.filter("label = 1").orderBy(*order).limit(most))
    else:
        picked = known.orderBy(*order).limit(most)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(picked), "doc")
    return found.groupBy("doc").agg(F.first("label").alias("label"), F.min("text").alias("text"))
