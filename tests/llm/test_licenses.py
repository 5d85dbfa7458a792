"""Against brute force over all windows, and the query against its SQL."""

import random
from collections import Counter

import duckdb
import pytest

from quillspark.llm import licenses as L

SCHEMA = "doc_id long, text string, license string, n int"


def texts():
    rng = random.Random(3)
    words = "the of and licensed under license version mit apache 2 0 ta re".split()
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 15)))
    out = [None, "", "\n\n", "word", "Licensed under CC BY-NC 4.0.", "licensed  UNDER cc-by nc 4 0\nlicensed under CC BY-NC 4.0"]
    for _, _, text in L.TEMPLATES:
        w = text.split()
        out.append(f"{line()}\n{text}\n{line()}")
        out.append(f"{line()}\n\n" + "\n".join(" ".join(w[i : i + 9]) for i in range(0, len(w), 9)) + f"\n \n{line()}")
        edited = list(w)
        edited[rng.randrange(len(w))] = "other"
        out.append(" ".join(edited))
        out.append(" ".join([text] * 2))
    return out + ["x " * 50000 + "\nReleased under the MIT License."] + ["hot\nReleased under the MIT License."] * 20


FEW = [t for t in L.TEMPLATES if t[:2] in (("Apache-2.0", "line"), ("MIT", "line"), ("MIT", "grant"), ("CC-BY-NC-4.0", "line"), ("BSD-3-Clause", "names"), ("GPL-3.0", "line"))]


def brute(rows, least):
    """Every window of every size; the first of equals by template, place and size."""
    best = {}
    for i, t, *_ in rows:
        grams = L.bigrams_of(t or "")
        for licence, name, text in FEW:
            other = Counter(L.bigrams_of(text))
            m = sum(other.values())
            for a in range(len(grams)):
                own, shared = Counter(), 0
                for b in range(a, min(len(grams), a + 3 * m)):
                    own[grams[b]] += 1
                    shared += own[grams[b]] <= other[grams[b]]
                    dice = 2 * shared / (b - a + 1 + m)
                    if dice >= least:
                        best[i, licence] = min(best.get((i, licence), (0,)), (-dice, name, a, b - a + 2))
    return sorted([(i, licence, v[1], -v[0], *v[2:]) for (i, licence), v in best.items()], key=str)


@pytest.mark.parametrize("least", [0.8, 0.6, 1.0])
def test_equals_brute_force(spark, least):
    short = [t for t in texts() if len(t or "") < 1200]
    rows = [(i, t, "x", 1) for i, t in enumerate(short)] + [(None, "so (Released under the MIT License.) it is", None, 1)]
    rows += [(900, "x\n * Licensed under the\n * Apache License, Version 2.0.\n * y", None, 1), (901, "of of Released under MIT the MIT License License MIT", None, 1)]
    rows += rows[-4:]  # repeated rows
    got = L.scan(spark.createDataFrame(rows, SCHEMA).repartition(3), least, FEW).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, least)


def test_a_notice_anywhere(spark):
    notice = "Released under the MIT License."
    rows = [(1, "x " * 50_000 + notice + " y" * 9, "", 1), (2, "word " * 7 + notice, "", 1), (3, "\n# ".join(["/*", *notice.split(), "*/"]), "", 1)]
    got = {r.doc_id: (r.license, r.dice, r.start_word) for r in L.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: ("MIT", 1.0, 50_000), 2: ("MIT", 1.0, 7), 3: ("MIT", 1.0, 0)}


def test_query_equals_sql_and_stays_native(spark, tmp_path):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts()) if len(t or "") < 5000]
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = L.scan(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    want = con.sql(f"SELECT doc_id, license, template, dice, start_word, n_words FROM ({L.scan_sql()})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert L.scan(empty).collect() == []
    assert L.scan(spark.createDataFrame([(1, "a b", "", 1)], SCHEMA), templates=[]).collect() == []
    with pytest.raises(ValueError):
        L.scan(empty, 0)


@pytest.mark.parametrize("least", [0.3, 0.8, 1.0])
def test_key_words_are_necessary(least):
    keys = L.key_words(least, L.TEMPLATES)
    for _, _, text in L.TEMPLATES:
        grams = L.bigrams_of(text)
        left = [g for g in grams if not set(g.split()) & set(keys)]
        n = max(1, len(left))
        assert 2 * len(left) / (len(grams) + n) < least
