"""Automata and the look-up of runs against substring search over the whole corpus."""

import math
import random

import numpy as np
import pytest

from quillspark.llm import lm_scoring as L

SCHEMA = "doc_id long, text string, score string, block int"


def direct(words, references, lengths=None):
    """The greedy parse by substring search; of ``lengths``, the longest that a match has room for."""
    joined = [tuple(r.encode().split()) for r in references]
    grams = {r[a:b] for r in joined for a in range(len(r)) for b in range(a + 1, len(r) + 1)}
    count = longest = at = 0
    while at < len(words):
        n = 1
        while at + n < len(words) and tuple(words[at : at + n + 1]) in grams and tuple(words[at : at + n]) in grams:
            n += 1
        if lengths is not None:
            n = max(m for m in lengths if m <= n)
        count, longest, at = count + 1, max(longest, n), at + n
    seen, phrase, c0 = set(), (), 0
    for w in words:
        phrase += (w,)
        if phrase not in seen:
            seen.add(phrase)
            phrase, c0 = (), c0 + 1
    c0 += bool(phrase)
    total = sum(map(len, joined))
    n = len(words)
    return n, count, c0, longest, total, (count * math.log2(max(total, 2)) - c0 * math.log2(c0)) / n if n else 0.0


def test_parse_equals_substring_search():
    rng = random.Random(8)
    for trial in range(60):
        letters = "abcdef"[: rng.randint(1, 6)]
        make = lambda n: " ".join(rng.choice(letters) for _ in range(n))
        references = [make(rng.randint(0, 25)) for _ in range(rng.randint(0, 4))]
        for text in [make(rng.randint(0, 30)), make(3) + " new " + make(4), "", "new", *references[:1]]:
            slab = L.Slab({"it": text.encode()})
            for t in references:
                slab.stream(None, t.encode())
            slab.settle()
            assert slab.phrases(0) == direct(text.encode().split(), references)[1::2][:1] + direct(text.encode().split(), references)[3:4]


def test_linear_size():
    a = L.SuffixAutomaton()
    a.extend([i * i % 1000 for i in range(50_000)] + [7] * 10_000)
    assert len(a.link) <= 2 * 60_000


def test_given_reference_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c x", "", 1), (2, None, "", 1)], SCHEMA)
    ref = spark.createDataFrame([(9, "z a b c", "", 1)], SCHEMA)
    got = {r.doc_id: (r.phrases, r.longest, r.reference_words) for r in L.cross_entropy(docs, ref).collect()}
    assert got == {1: (2, 3, 4), 2: (0, 0, 4)}
    assert L.cross_entropy(docs.limit(0)).collect() == []
    assert {r.phrases for r in L.cross_entropy(docs, ref.limit(0)).collect()} == {4, 0}


def test_search_of_the_whole_corpus(spark):
    rng = random.Random(6)
    make = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    rows = [(i, make(rng.randint(0, 40)), None, 1) for i in range(40)]
    rows += [(60, "x y z " + rows[3][1], None, 1), (61, "m " * 50, None, 1), (62, None, None, 1), (63, "", None, 1), (64, "same text twice", None, 1), (65, "same text twice", None, 1)]
    rows += [(66, "only of one row", None, 1)] * 2 + [(None, "of null and 67", None, 1), (67, "of null and 67", None, 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    texts = {t or "" for _, t, *_ in rows}
    ids = {t: {d for d, u, *_ in rows if (u or "") == t} for t in texts}
    want = sorted(str((d, *direct((t or "").encode().split(), [u for u in texts if u != (t or "") or len(ids[u]) > 1]))) for d, t, *_ in rows)
    for batch, bucket in ((60, 37), (1 << 20, 1 << 21)):
        lengths = L.LENGTHS.tolist()
        near = sorted(str((d, *direct((t or "").encode().split(), [u for u in texts if u != (t or "") or len(ids[u]) > 1], None if len(ids[t or ""]) > 1 else lengths))) for d, t, *_ in rows)
        assert sorted(str(tuple(r)) for r in L.corpus_parse(df, batch=batch, bucket=bucket).collect()) == near
    for slab in (200, 1 << 20):
        assert sorted(str(tuple(r)) for r in L.search_all(df, slab=slab).collect()) == want
    ref = spark.createDataFrame([(i, t, None, 1) for i, t in enumerate(("a b " * 30_000, "c d e f " * 75_000, "g h a"))], SCHEMA)
    docs = spark.createDataFrame([(i, "a b a b c d e f c g h a", str(i), 1) for i in range(20)], SCHEMA)
    assert {(r.phrases, r.longest) for r in L.cross_entropy(docs, ref).collect()} == {(3, 5)}


def test_long_passages_of_the_corpus(spark):
    """Phrases of every order of length, shared between batches and within one."""
    rng = random.Random(12)
    passage = [f"w{i}" for i in range(1500)]
    rows = [(i, " ".join([f"o{i}"] * 3 + passage[a : a + n] + [f"p{i}"] + passage[:5]), None, 1) for i, (a, n) in enumerate((rng.randint(0, 500), rng.choice((9, 11, 17, 40, 300, 900))) for _ in range(12))]
    df = spark.createDataFrame(rows, SCHEMA)
    joined = [r[1].split() for r in rows]

    def longest(i, p):
        n = 0
        while p + n < len(joined[i]) and any(" " + " ".join(joined[i][p : p + n + 1]) + " " in f" {r[1]} " for r in rows if r[0] != i):
            n += 1
        return n

    want = {}
    for i, words in enumerate(joined):
        p = count = most = 0
        while p < len(words):
            n = max([m for m in L.LENGTHS.tolist() if m <= longest(i, p)], default=1)
            p, count, most = p + n, count + 1, max(most, n)
        want[i] = (count, most)
    for batch in (2000, 1 << 20):
        assert {r.doc_id: (r.phrases, r.longest) for r in L.corpus_parse(df, batch=batch, bucket=500).collect()} == want
    assert L.corpus_parse(df.limit(0)).collect() == []


def test_matches_of_every_length_in_the_corpus(spark):
    """Near copies with changes at other places each, prefixes of every length, one word repeated, text that two ids have."""
    rng = random.Random(21)
    passage = [f"w{i}" for i in range(90)]
    texts = [" ".join(passage[:n]) for n in range(7, 40)] + [" ".join(["m"] * n) for n in (9, 13, 30, 31)]
    for i in range(25):
        words = [w for w in passage[rng.randint(0, 20) : rng.randint(60, 90)] for _ in range(1 + (rng.random() < 0.02))]
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"x{i}"
        texts.append(" ".join(words))
    rows = [(i, t, None, 1) for i, t in enumerate([*texts, texts[-1], texts[-2]])]
    ids = {t: sum(u == t for _, u, *_ in rows) for t in texts}
    want = sorted(str((d, *direct(t.encode().split(), [u for u in ids if u != t or ids[u] > 1]))) for d, t, *_ in rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    for batch, bucket in ((300, 200), (1 << 20, 1 << 21)):
        assert sorted(str(tuple(r)) for r in L.corpus_parse(df, batch=batch, bucket=bucket).collect()) == want


def test_later_rounds_keep_few_words():
    """Places that are kept have the same hashes and bounds as before, out of no more words than they reach."""
    rng = random.Random(4)
    words = np.array([rng.getrandbits(64) for _ in range(500)], dtype=np.uint64)
    meta = np.array([[300, 0, 1], [0, 0, 1], [200, 2, 1]], dtype=np.int64)
    at = np.array([*range(5, 60), *range(64, 90), *range(292 - 40, 292), *range(300, 330), *range(400, 492)])
    last = np.append(np.diff(at) > 1, True)
    high = at[np.flatnonzero(last)[np.cumsum(last) - last]] + L.SHORT
    row = {"batch": 1, "file": "f", "at": L._planes(np.diff(at, prepend=0).astype(np.uint32)), "low": L._planes(np.full(len(at), L.SHORT, dtype=np.uint32)), "high": L._planes((high - at - L.SHORT).astype(np.uint32)), "words": None}
    pack = {"meta": meta.tobytes(), "words": words.tobytes(), "ids": L._planes(np.arange(500, dtype=np.uint32))}
    p = L._Passages(row, lambda _: pack)
    whole = L.rolled(words, 11)
    k = np.flatnonzero(p.high - p.at >= 11)
    assert (p.hashes(k, np.full(len(k), 11)) == whole[p.at[k]]).all()
    for _ in range(20):
        keep = np.array(sorted(rng.sample(k.tolist(), rng.randint(1, 30))))
        q = L._Passages(next(p.packed(keep)).to_pylist()[0], None)
        for name in ("at", "low", "high", "text", "copied"):
            assert (getattr(q, name) == getattr(p, name)[keep]).all()
        assert (q.hashes(np.arange(len(keep)), np.full(len(keep), 11)) == whole[q.at]).all()
        assert len(q.joins[0]) == len({w for a, b in zip(q.at, q.high) for w in range(a, b)})
