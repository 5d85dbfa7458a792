"""Each stage against a brute-force version of its decision, on a small corpus written as tables."""

import random
import zlib
from collections import Counter

import pytest

import corpus_pipeline as P
from tests.llm.test_bpe import expected
from tests.llm.test_simhash_dedup import brute_classes, defined


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(2)
    where = str(tmp_path_factory.mktemp("tables"))
    vocabulary = [a + b + c for a in ("the", "on", "re", "th", "an") for b in ("in", "ou", "er", "a") for c in ("s", "nd", "t", "ly")]
    prose = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", ","]) for _ in range(n)).capitalize()
    item = prose(30)
    passage = prose(60)
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = prose(rng.randint(30, 90))
        text = " ".join(w + "&&&%" for w in text.upper().split()) if bad else text
        docs.append((i, text))
        if i % 3:
            labels.append((i, 0 if bad else 1, 0))
    docs += [(1000 + i, docs[1 + 4 * i][1]) for i in range(20)]
    docs += [(2000 + i, prose(40) + "\n" + passage + "  " + prose(40)) for i in range(5)]
    docs += [(3000, prose(20) + " " + item + " " + prose(5)), (4000, None), (4001, "")]
    spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, item), (2, prose(25))], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def rows(df):
    return sorted((r.doc_id, r.text, r.n_chars) for r in df.collect())


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = P.keep_quality(spark, docs, folder)
    assert kept.columns == columns
    first = rows(kept)
    truth = {r[0]: not ("&&&" in (r[1] or "")) for r in rows(docs)}
    got = {r[0] for r in first}
    assert all((i in got) == good for i, good in truth.items() if i < 4000)
    assert {zlib.crc32(str(i).encode()) % 3 for i in got} == {0, 1, 2}

    second_df = P.drop_near_duplicates(spark, kept, folder)
    assert second_df.columns == columns
    prints = [defined(r[1]) for r in first]
    classes = brute_classes(prints)
    assert rows(second_df) == [r for k, r in enumerate(first) if classes.index(classes[k]) == k]

    second = rows(second_df)
    third_df = P.cut_repeated_passages(spark, second_df, folder)
    assert third_df.columns == columns
    words = [(r[1] or "").encode().split() for r in second]
    seen = Counter(tuple(w[a : a + 35]) for w in words for a in range(len(w) - 34))
    want = []
    for r, w in zip(second, words):
        gone = {x for a in range(len(w) - 34) if seen[tuple(w[a : a + 35])] > 1 for x in range(a, a + 35)}
        text = b" ".join(x for a, x in enumerate(w) if a not in gone).decode() if gone else r[1]
        want.append((r[0], text, len(text) if gone else r[2]))
    assert rows(third_df) == want and any(a != b for a, b in zip(want, second))

    fourth_df = P.drop_contaminated(spark, third_df, folder)
    assert fourth_df.columns == columns
    fourth = rows(fourth_df)
    assert {r[0] for r in want} - {r[0] for r in fourth} == {3000}

    fifth = P.encode_tokens(spark, fourth_df, folder).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in fifth) == [(r[0], *expected(r[1])) for r in fourth]

    whole = P.run(spark, folder).collect()
    assert sorted(map(str, whole)) == sorted(map(str, fifth))
    assert len(P.STAGES) == 5


def test_empty_documents(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
