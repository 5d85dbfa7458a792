"""Fingerprints against the definition, links and classes against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from quillspark.llm import simhash_dedup as S
from quillspark.llm.components import components

SCHEMA = "doc_id long, text string, fp int, component_id string"


def defined(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_classes(prints):
    root = {i: i for i in range(len(prints))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def texts():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    out = [None, "", " \n\t", "one", "one two three", "One TWO three", "a b c d", "É é"]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(rng.choice([" ", "  ", "\n"]).join(copy))
    return out + ["long " * 20000 + "tail"] + ["hot copy of one text again and again"] * 30


@pytest.mark.parametrize("tile", [4096, 2])
def test_equals_brute_force(spark, tile):
    rows = [(i * 3 % 1000, t, 1, None) for i, t in enumerate(texts())]
    got = S.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), tile=tile).collect()
    prints = [defined(r[1]) for r in rows]
    found = brute_classes(prints)
    least = {}
    for r, c in zip(rows, found):
        least[c] = min(least.get(c, 10**9), r[0])
    want = sorted((r[0], f"{p:016x}", least[c]) for r, p, c in zip(rows, prints, found))
    assert sorted(map(tuple, got)) == want
    kept = S.keep_one(spark.createDataFrame(rows, SCHEMA), tile=tile)
    assert kept.columns == ["doc_id", "text", "fp", "component_id"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))


@pytest.mark.parametrize("groups,tile", [(None, 4096), (8, 4096), (5, 7), (6, 1)])
def test_links_connect_all_within_the_radius(spark, groups, tile):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = {int(c) for c in centres} | {0, (1 << 64) - 1}
    for c in centres.tolist():
        for _ in range(12):
            x = c
            for b in rng.integers(0, 64, rng.integers(1, 7)).tolist():
                x ^= 1 << b
            prints.add(x)
    values = sorted(prints)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    links = S.fingerprint_links(spark.createDataFrame(signed, "fp long"), groups=groups, tile=tile).collect()
    for a, b in links:
        assert ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4
    place = {v[0]: i for i, v in enumerate(signed)}
    roots = list(range(len(values)))

    def find(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for a, b in links:
        x, y = find(place[a]), find(place[b])
        roots[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(values))] == brute_classes(values)


def test_nulls_ties_and_empty_table(spark):
    rows = [(None, "same text", 1, None), (None, "same text", 1, None), (7, None, 1, None), (7, None, 1, None), (None, "quite another text of several words", 1, None), (9, "same  Text", 1, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc, r.component_id) for r in S.near_duplicates(df).collect()}
    assert got == {(None, 9), (7, 7), (None, None), (9, 9)}
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in S.keep_one(df).collect()) == [(False, 7, None), (False, 9, "same  Text"), (True, None, "quite another text of several words")]
    empty = spark.createDataFrame([], SCHEMA)
    assert S.near_duplicates(empty).collect() == [] and S.keep_one(empty).collect() == []


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(7, 7), (200, None), (300, 299), (300, 299)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    want = {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)} | {299: 299, 300: 299}
    assert got == want


def test_grid_grows_with_the_fingerprints():
    sizes = [S.grid(n, 4) for n in (0, 1000, 250_000, 15_000_000, 10**9, 10**12)]
    assert sizes == sorted(sizes) and sizes[0] == 5 and sizes[2] == 6 and max(sizes) <= 10


def test_keep_one_with_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "a b c d e", "x", 1), (1, "a b c d e", "y", 2), (2, "a b c d e", "z", 3), (3, None, "n", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k1 string, `__k2` int")
    first = sorted(map(tuple, S.keep_one(df).collect()))
    assert [r[0] for r in first] == [1, 3] and first[0] in rows
    assert sorted(map(tuple, S.keep_one(df.repartition(3)).collect())) == first
