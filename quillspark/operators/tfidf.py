"""TF-IDF over a corpus of token arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import dicts
from quillspark.functions.text import tokens


def term_counts(docs: DataFrame, id_col: str, *weighted: tuple[Column, int], only: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, n): occurrences of tokens, a text counted as often as its weight; of the terms in ``only``, if given."""
    parts = F.flatten(F.array(*(F.array_repeat(F.struct(tokens(c).alias("t"), F.lit(w).alias("w")), 1) for c, w in weighted)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(parts).alias("p"))
    terms = rows.select("doc_id", F.explode("p.t").alias("term"), F.col("p.w").alias("w"))
    terms = terms if only is None else terms.join(only.select("term").distinct(), "term", "left_semi")
    return terms.groupBy("doc_id", "term").agg(F.sum("w").alias("n"))


def partitions(df: DataFrame, each: int = 8 << 20) -> int:
    """How many partitions ``df`` should be dealt to for ``each`` bytes of its files in one; as many as cores at least."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(df.sparkSession.sparkContext.defaultParallelism, min(-(-size // each), 1 << 15))


def matches(docs: DataFrame, id_col: str, wanted: DataFrame, *weighted: tuple[Column, int]) -> DataFrame:
    """``term_counts`` of the terms in ``wanted``, all rows of a document in one partition.

    What is joined by term and summed by document after it needs no exchange, so no task has all rows of a common term;
    partitions grow in number with the documents, not in size.
    """
    parts = F.array(*(F.struct(tokens(c).alias("t"), F.lit(w).alias("w")) for c, w in weighted))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(parts).alias("p"))
    terms = rows.select("doc_id", F.explode("p.t").alias("term"), F.col("p.w").alias("w"))
    terms = terms.join(F.broadcast(wanted.select("term").distinct()), "term", "left_semi")
    return terms.repartition(partitions(docs), "doc_id").groupBy("doc_id", "term").agg(F.sum("w").alias("n"))


def log_tf(n: Column) -> Column:
    return 1 + F.log(n.cast("double"))


def idf(df: Column, docs: Column, term: Column, boost: float = 1.3) -> Column:
    plain = F.log(docs / F.greatest(df, F.lit(1))) + 1
    return plain * F.when(term.isin(dicts.IMPORTANT_TERMS), boost).otherwise(1.0)


def document_frequency(counts: DataFrame) -> DataFrame:
    # counts n, so that no column is pruned and the exchange of ``counts`` is used again
    return counts.groupBy("term").agg(F.count("n").alias("df"))


def inverse_frequency(counts: DataFrame, docs: DataFrame, boost: float = 1.3) -> DataFrame:
    """(term, df, idf); the number of documents is one row, joined in."""
    total = docs.agg(F.count(F.lit(1)).alias("docs"))
    return document_frequency(counts).crossJoin(F.broadcast(total)).select("term", "df", idf(F.col("df"), F.col("docs"), F.col("term"), boost).alias("idf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, times) of requests (query_id, query)."""
    return queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def scores(counts: DataFrame, weights: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): tf * idf summed over query terms, repeats counted; pairs without a term are left out.

    The requests' terms are broadcast, for a common one has all documents; ``counts`` are those of ``matches``.
    """
    asked = wanted.join(F.broadcast(weights.select("term", "idf")), "term").select("term", "query_id", (F.col("idf") * F.col("times")).alias("weight"))
    matched = counts.join(F.broadcast(asked), "term")
    return matched.groupBy("query_id", "doc_id").agg(F.sum(log_tf(F.col("n")) * F.col("weight")).alias("score"))


def normalised(scored: DataFrame, top: float = 30.0) -> DataFrame:
    """score / max(score) * top within each query; a row for each query is broadcast, no task has all of one."""
    best = scored.groupBy(F.col("query_id").alias("__q")).agg(F.max("score").alias("__best"))
    joined = scored.join(F.broadcast(best), F.col("query_id").eqNullSafe(F.col("__q")))
    return joined.withColumn("points", F.col("score") / F.when(F.col("__best") < 0.001, 1.0).otherwise(F.col("__best")) * top).drop("__q", "__best")


def inverted_index(counts: DataFrame, block: int = 1 << 16) -> DataFrame:
    """(term, block, doc_ids): postings in blocks of ids, so that no row holds all documents of a common word."""
    return counts.groupBy("term", F.floor(F.col("doc_id") / block).alias("block")).agg(F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))
