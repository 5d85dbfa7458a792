"""Trees against path enumeration in Python; the template's round trip; the query against its SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.llm import chat_format as C
from quillspark.llm.queries import ORACLE_SQL, op9_chat_format

SCHEMA = "conv_id long, msg_id long, parent_id long, role string, text string, score double, conv string, leaf int"
HARD = "a\\b [INST] </s> <|end|>\n<|turn|>x\n \\z \\l \\\\ é😀 <|im_start|>"


def trees():
    rng = random.Random(5)
    rows = []
    for conv in [None, *range(12)]:
        for i in range(rng.randint(1, 25)):
            rows.append((conv, i, rng.randrange(i) if i else None, rng.choice(["user", "assistant", None, "a\nb[<\\"]), rng.choice([HARD, "", None, f"text {i}"]), rng.choice([None, 0.0, 1.0, -2.0]), "x", 1))
    rows += [(50, i, i - 1 if i else None, "assistant", f"t{i}", 1.0, "x", 1) for i in range(300)]
    rows += [(60, 1, 2, "user", "cycle", 1.0, "x", 1), (60, 2, 1, "user", "cycle", 1.0, "x", 1), (60, 3, 2, "user", "below", 9.0, "x", 1), (60, 4, 77, "user", "orphan", 0.0, "x", 1)]
    return rows + rows[3:9] + [(5, None, 1, "user", "no id", 1.0, "x", 1)]


def brute(rows, best):
    out = []
    convs = {}
    for r in rows:
        if r[1] is not None:
            convs.setdefault(r[0], {})[r[1]] = r
    for conv, m in convs.items():
        parents = {r[2] for r in m.values()}
        paths = []
        for i, r in m.items():
            if i in parents:
                continue
            path, seen = [], set()
            while r and r[1] not in seen:
                path.append(r)
                seen.add(r[1])
                r = m.get(r[2])
            if r is None:
                paths.append((-sum(x[5] or 0 for x in path), i, path[::-1]))
        for _, leaf, path in sorted(paths, key=lambda p: p[:2])[:best]:
            out.append((conv, leaf, [(x[3] or "", x[4] or "") for x in path]))
    return sorted(out, key=str)


@pytest.mark.parametrize("best", [1, 3])
def test_paths_and_round_trip(spark, best):
    rows = trees()
    made = C.format_paths(spark.createDataFrame(rows, SCHEMA).repartition(3), best, score_col="score")
    made.persist()
    got = {(r.conv_id, r.leaf_id): r for r in made.collect()}
    back = C.read_back(made).collect()
    want = brute(rows, best)
    assert sorted(((r.conv_id, r.leaf_id, [(t.role, t.text) for t in r.turns]) for r in back), key=str) == want
    for r in back:
        assert r.loss_text == "".join(t.text for t in r.turns if t.role == "assistant")
        g = got[r.conv_id, r.leaf_id]
        for t, span in zip(r.turns, g.loss, strict=True):
            body = g.formatted[span.start : span.start + span.length]
            assert "[" not in body and "<" not in body
            assert body.replace("\\b", "[").replace("\\l", "<").replace("\\z", "\\") == (t.text if t.role == "assistant" else "")
        assert g.formatted.count("<") == 2 * len(r.turns)


def test_linear_ties_nulls_and_empty_table(spark):
    schema = "conv_id long, turn long, role string, text string, msg_id string"
    rows = [(1, 1, "user", "b", ""), (1, 1, "user", "a", ""), (1, None, "system", None, ""), (1, 2, "assistant", "same", ""), (1, 2, "assistant", "same", ""), (None, 0, None, "x", "")]
    df = spark.createDataFrame(rows, schema)
    back = C.read_back(C.format_paths(C.linear(df))).collect()
    got = {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss_text) for r in back}
    assert got == {1: ([("system", ""), ("user", "a"), ("user", "b"), ("assistant", "same"), ("assistant", "same")], "samesame"), None: ([("", "x")], "")}
    assert C.format_paths(C.linear(df.limit(0))).collect() == []


def test_query_equals_sql(spark, tmp_path):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice([HARD, None, "", f"say {c} {t}"])) for c in range(20) for t in range(rng.randint(1, 9))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    df = op9_chat_format(spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL['op9_chat_format']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
