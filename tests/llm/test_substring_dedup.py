"""Against brute force: every window of every text in one dictionary."""

import hashlib
import random
from collections import Counter

import pytest

from quillspark.llm.substring_dedup import remove_repeated

SCHEMA = "doc_id long, text string, hot string, mhash int"


def brute(rows, k):
    words = [(r[1] or "").encode().split() for r in rows]
    seen = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for r, w in zip(rows, words):
        gone = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone |= set(range(i, i + k))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(7)
    word = lambda: rng.choice("a b c dé  x f g".split(" "))
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 40))), None, 1) for i in range(30)]
    rows += [(100 + i, "\n".join([*(f"u{i}.{j}" for j in range(rng.randint(0, 9)))] + passage[i : i + 30] + [f"v{i}"]), "x", None) for i in range(8)]
    rows += [(200, None, None, None), (201, "", None, None), (202, " \t\n", None, None), (None, " ".join(passage), None, 3), (None, " ".join(passage), None, 3), (5, "other text of a repeated id", None, 1)]
    rows += [(300, " ".join(["same"] * 3000), None, 1), (301, " ".join(f"w{i % 50}" for i in range(20000)), None, 1)]
    rows += [(400 + i, "very hot copy of one text with words enough for windows", None, 1) for i in range(40)]
    return rows


@pytest.mark.parametrize("k,m,hot", [(5, 2, 2_000_000), (5, 5, 20), (3, 1, 1), (9, 4, 50)])
def test_equals_brute_force(spark, k, m, hot):
    rows = corpus()
    got = remove_repeated(spark.createDataFrame(rows, SCHEMA).repartition(3), k=k, m=m, hot=hot, carry=["hot"]).drop("hot").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, k)


def test_empty_table_and_bad_parameters(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert remove_repeated(empty).collect() == []
    with pytest.raises(ValueError):
        remove_repeated(empty, k=3, m=4)


def test_words_that_differ_only_in_the_order_of_a_pattern(spark):
    """Thue-Morse words collide under every polynomial hash modulo a power of two."""
    a = "a"
    while len(a) < 1024:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    for n in (8, 64, 512, 1024):
        rows = [(1, " ".join(["same"] * 34 + [a[:n]]), "", 1), (2, " ".join(["same"] * 34 + [b[:n]]), "", 1)]
        assert [r.n_removed for r in remove_repeated(spark.createDataFrame(rows, SCHEMA)).collect()] == [0, 0]
    rows = [(1, " ".join(a[:64]), "", 1), (2, " ".join(b[:64]), "", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, remove_repeated(df, k=64, m=8).collect()), key=str) == brute(rows, 64)
