"""Queries over documents: tokens, TF-IDF, SimHash."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import dicts, text
from quillspark.operators import dedup, tfidf

from .catalog import query, table, words

_STOP = words(dicts.STOP_WORDS)
_IMPORTANT = words(dicts.IMPORTANT_TERMS)
_TOK = f"list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) >= 2 AND NOT list_contains({_STOP}, w))"
_TF = f"tf AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY ALL)"
_IDF = f"idf AS (SELECT term, count(*) AS df, (ln((SELECT count(*) FROM documents)::DOUBLE / count(*)) + 1) * CASE WHEN list_contains({_IMPORTANT}, term) THEN 1.3 ELSE 1.0 END AS idf FROM tf GROUP BY term)"
_Q = f"q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TOK}) AS term FROM benchmark) GROUP BY ALL)"
_S = "s AS (SELECT item_id AS query_id, doc_id, sum((1 + ln(n)) * idf * times) AS score FROM tf JOIN q USING (term) JOIN idf USING (term) GROUP BY ALL)"


def _counts(spark, sf_dir):
    return tfidf.term_counts(table(spark, sf_dir, "documents"), "doc_id", (F.col("text"), 1))


def _weights(spark, sf_dir):
    return tfidf.inverse_frequency(_counts(spark, sf_dir), table(spark, sf_dir, "documents"))


def _scores(spark, sf_dir):
    requests = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    wanted, docs = tfidf.query_terms(requests), table(spark, sf_dir, "documents")
    counts = tfidf.matches(docs, "doc_id", wanted, (F.col("text"), 1))  # idf is of these terms only, too
    return tfidf.scores(counts, tfidf.inverse_frequency(counts, docs), wanted)


@query(f"SELECT doc_id, len({_TOK}) AS n_tokens, array_to_string({_TOK}, ' ') AS tokens FROM documents")
def tokenize_docs(spark, sf_dir):
    t = text.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@query(f"WITH {_TF} SELECT doc_id, term, n, round(1 + ln(n), 6) AS tf FROM tf")
def term_freq(spark, sf_dir):
    return _counts(spark, sf_dir).withColumn("tf", F.round(tfidf.log_tf(F.col("n")), 6))


@query(f"WITH {_TF} SELECT term, count(*) AS df FROM tf GROUP BY term")
def doc_freq(spark, sf_dir):
    return tfidf.document_frequency(_counts(spark, sf_dir))


@query(f"WITH {_TF}, {_IDF} SELECT term, df, round(idf, 6) AS idf FROM idf")
def inverse_doc_freq(spark, sf_dir):
    return _weights(spark, sf_dir).withColumn("idf", F.round("idf", 6))


@query(f"WITH {_TF} SELECT term, doc_id // 65536 AS block, count(*) AS n_docs, string_agg(doc_id::STRING, ' ' ORDER BY doc_id) AS docs FROM tf GROUP BY term, block")
def inverted_index(spark, sf_dir):
    index = tfidf.inverted_index(_counts(spark, sf_dir))
    return index.select("term", "block", F.size("doc_ids").cast("long").alias("n_docs"), F.array_join(F.col("doc_ids").cast("array<string>"), " ").alias("docs"))


@query(f"WITH {_TF}, {_Q} SELECT item_id, count(DISTINCT doc_id) AS n_docs FROM q JOIN tf USING (term) GROUP BY item_id")
def index_lookup(spark, sf_dir):
    wanted = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("term"))
    counts = tfidf.matches(table(spark, sf_dir, "documents"), "doc_id", wanted, (F.col("text"), 1))
    found = counts.filter("doc_id IS NOT NULL").join(F.broadcast(wanted), "term").select("item_id", "doc_id").distinct()
    return found.groupBy("item_id").agg(F.count("doc_id").alias("n_docs"))


@query(f"WITH {_TF}, {_IDF}, {_Q}, {_S} SELECT query_id, doc_id, round(score, 4) AS score FROM s")
def tfidf_scores(spark, sf_dir):
    return _scores(spark, sf_dir).withColumn("score", F.round("score", 4))


@query(f"WITH {_TF}, {_IDF}, {_Q}, {_S} SELECT query_id, doc_id, round(score / max(score) OVER (PARTITION BY query_id) * 30, 4) AS points FROM s")
def tfidf_normalized(spark, sf_dir):
    return tfidf.normalised(_scores(spark, sf_dir)).select("query_id", "doc_id", F.round("points", 4).alias("points"))


@query(f"WITH {_TF} SELECT doc_id, round(sum((1 + ln(n)) * (ln(1000.0 / n) + 1) * CASE WHEN list_contains({_IMPORTANT}, term) THEN 1.5 ELSE 1.0 END), 4) AS score FROM tf GROUP BY doc_id")
def tfidf_single_doc(spark, sf_dir):
    weight = tfidf.idf(F.col("n"), F.lit(1000.0), F.col("term"), 1.5)
    return _counts(spark, sf_dir).groupBy("doc_id").agg(F.round(F.sum(tfidf.log_tf(F.col("n")) * weight), 4).alias("score"))


_FNV = "((xor(((xor(14695981039346656037::UBIGINT, unicode(substr(g, 1, 1))::UBIGINT)::HUGEINT * 1099511628211) % 18446744073709551616)::UBIGINT, unicode(substr(g, 2, 1))::UBIGINT)::HUGEINT * 1099511628211) % 18446744073709551616)::UBIGINT"
_BITS = " + ".join(f"CASE WHEN sum(n * (2 * ((h >> {b}) & 1)::BIGINT - 1)) > 0 THEN {1 << b}::HUGEINT ELSE 0 END" for b in range(64))
_SIMHASH = f"""
WITH c AS (SELECT doc_id, lower(text) AS t FROM documents),
g AS (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, unnest(CASE WHEN length(t) < 2 THEN [] ELSE list_transform(range(1, length(t)), lambda i: substr(t, i, 2)) END) AS g FROM c) GROUP BY ALL),
p AS (SELECT doc_id, n, {_FNV} AS h FROM g),
s AS (SELECT doc_id, {_BITS} AS u FROM p GROUP BY doc_id)
"""


def _hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), dedup.simhash_of(F.col("text")).alias("simhash"))


@query(_SIMHASH + "SELECT doc_id, coalesce(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END, 0)::BIGINT AS simhash FROM documents LEFT JOIN s USING (doc_id)")
def simhash64(spark, sf_dir):
    return _hashes(spark, sf_dir).withColumnRenamed("id", "doc_id")


@query(_SIMHASH + ", d AS (SELECT DISTINCT u::UBIGINT AS u FROM s) SELECT bit_count(xor(a.u, b.u))::INT AS distance, count(*) AS pairs FROM d a JOIN d b ON a.u < b.u AND bit_count(xor(a.u, b.u)) <= 5 GROUP BY 1")
def hamming_pairs(spark, sf_dir):
    """Pairs of distinct hashes within 5 bits, by distance; a text without bigrams has no hash here."""
    docs = table(spark, sf_dir, "documents").filter(F.length(F.lower("text")) >= 2)
    return dedup.pairs_within(docs.select(dedup.simhash_of(F.col("text")).alias("simhash")))
