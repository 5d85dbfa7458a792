"""Against brute force: every window of every item's size, and its similarity by counting shingles."""

import random
from collections import Counter

import numpy as np

from quillspark.llm import decontaminate as D

DOCS = "doc_id long, text string, item_id int, similarity string"
ITEMS = "item_id long, text string, doc_id string"


def similarity(a, b):
    x = Counter(tuple(a[i : i + 5]) for i in range(len(a) - 4))
    y = Counter(tuple(b[i : i + 5]) for i in range(len(b) - 4))
    return sum((x & y).values()) / sum((x | y).values())


def brute(docs, items):
    out = set()
    for d in docs:
        w = (d[1] or "").encode().lower().split()
        for i in items:
            v = (i[1] or "").encode().lower().split()
            if not v or len(v) > len(w):
                continue
            best = (0, 0)
            for a in range(len(w) - len(v) + 1):
                s = similarity(w[a : a + len(v)], v) if len(v) >= 5 else float(w[a : a + len(v)] == v)
                best = min(best, (-s, a))
            if -best[0] >= 0.8:
                out.add((d[0], i[0], round(-best[0], 9), best[1], len(v)))
    return out


def data():
    rng = random.Random(11)
    word = lambda: rng.choice([f"w{i}" for i in range(40)])
    items = [(i, " ".join(word() for _ in range(rng.randint(15, 60))), None) for i in range(30)]
    items += [(90, "a b", None), (91, "", None), (92, None, None), (None, "one two three", None), (93, "x y z u v", None), (94, "rep " * 20, None)]
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 80))), 1, None) for i in range(25)]
    for k in range(60):
        words = items[rng.randrange(30)][1].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            at = rng.randrange(len(words))
            rng.choice([lambda: words.__setitem__(at, "edit"), lambda: words.insert(at, "more"), lambda: words.pop(at)])()
        docs.append((100 + k, " ".join([word() for _ in range(rng.randint(0, 30))]) + "\n" + " ".join(words).upper() + " " + word(), 1, None))
    docs += [(200, None, 1, None), (201, "", 1, None), (None, "A  b one Two three", 1, "s"), (202, "x y z u v", 1, None), (202, "x y z u v", 1, None), (203, "rep " * 30000, 1, None)]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = data()
    df, bench = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)
    for block in (4 << 20, 400):
        got = D.contamination(df, bench, block=block).collect()
        assert {(r.doc_id, r.item_id, round(r.similarity, 9), r.start_word, r.n_words) for r in got} == brute([d for d in docs if d[0] != 203], items) | {(203, 94, 1.0, 0, 20)}
        assert sum(r.doc_id == 202 for r in got) == 2
    kept = D.clean(df, bench)
    assert kept.columns == df.columns
    bad = {r.doc_id for r in got}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d[0]) for d in docs if d[0] not in bad)


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    prints = [int(x) for x in rng.integers(0, 1 << 63, 300, dtype=np.uint64)]
    index = D.MultiIndex.of(prints, 23)
    for p in [int(x) for x in rng.integers(0, 1 << 63, 50, dtype=np.uint64)] + [p ^ 0xF0F0F for p in prints[:50]]:
        assert index.near(p, 23) == [(i, (p ^ q).bit_count()) for i, q in enumerate(prints) if (p ^ q).bit_count() <= 23]


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a b c d e f", 1, None)], DOCS)
    assert D.contamination(docs, bench).collect() == [] and D.contamination(some, bench).collect() == []
    assert D.clean(some, bench).count() == 1 and D.clean(docs, bench).count() == 0


def test_documents_shorter_than_an_item(spark):
    rng = random.Random(5)
    items = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(n)), None) for i, n in enumerate((59, 40, 25, 12, 6))] + [(9, "rep " * 20, None)]
    docs = [(0, " ".join(items[0][1].split()[:-1]), 1, None), (1, "w1 w2 w3", 1, None), (2, "rep " * 18, 1, None)]
    for k in range(200):
        words = items[k % 5][1].split()
        cut = rng.randint(0, 12)
        at = rng.randint(0, cut)
        words = words[at : len(words) - cut + at]
        if words and rng.random() < 0.3:
            words[rng.randrange(len(words))] = "edit"
        docs.append((10 + k, " ".join(words), 1, None))
    want = brute(docs, items)
    for d in docs:
        w = d[1].split()
        for i in items:
            v = i[1].split()
            if 5 <= len(w) < len(v) and (s := similarity(w, v)) >= 0.8:
                want.add((d[0], i[0], round(s, 9), 0, len(w)))
    df, bench = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)
    for block in (4 << 20, 200):
        got = {(r.doc_id, r.item_id, round(r.similarity, 9), r.start_word, r.n_words) for r in D.contamination(df, bench, block=block).collect()}
        assert got == want and (0, 0, round(54 / 55, 9), 0, 58) in got
    bad = {d for d, *_ in want}
    assert {r.doc_id for r in D.clean(df, bench).collect()} == {d[0] for d in docs} - bad
