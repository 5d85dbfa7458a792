"""Against the tokenizers library itself, on prose, odd Unicode, special tokens and long runs."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspark.llm import bpe

PATH = bpe.default_path()
LIBRARY = Tokenizer.from_file(PATH)
SCHEMA = "doc_id long, text string, ids string, route int"


def expected(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    decoded = LIBRARY.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def texts():
    rng = random.Random(1)
    words = "the of naïve don't I'll 12 3.5 éa <|endoftext|> a<|endoftext|>b x y 　   日本語 😀 \t \n\n ### ''s 's".split(" ")
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 400))) for _ in range(30)]
    shared = " ".join(f"shared{i} passage" for i in range(200))
    return [None, "", " ", "\x00", "a", "<|endoftext|>", "<|endof text|>", *prose, *(f"{p[:50]} {shared} {p[-40:]}" for p in prose[:9]), "a" * 5000, " " * 3000, "ab " * 30000, *[shared] * 20]


@pytest.mark.parametrize("bits", [8, 3, 0])
def test_equals_the_library(spark, bits):
    rows = [(i if i % 9 else None, t, None, 1) for i, t in enumerate(texts())] * 2
    got = bpe.encode(spark.createDataFrame(rows, SCHEMA), bits=bits, bound=1 << 14).collect()
    assert sorted([(r.doc, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got], key=str) == sorted([(r[0], *expected(r[1])) for r in rows], key=str)
    assert all(len(r.ids) == r.n_tokens for r in got)


def test_decode_and_empty_table(spark):
    df = bpe.encode(spark.createDataFrame([(1, "naïve 😀 text", None, 1)], SCHEMA))
    assert [r.text for r in bpe.decode(df).collect()] == ["naïve 😀 text"]
    assert bpe.encode(spark.createDataFrame([], SCHEMA)).collect() == []


def test_chunks_are_encoded_once():
    encoder = bpe.ChunkEncoder(PATH)
    assert encoder.codec.fast
    text = " ".join(f"word{i} of prose" for i in range(4000)).encode()
    import numpy as np

    cut, _ = bpe.cuts_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 8)
    for _ in range(3):
        encoder.ids(text, cut.tolist())
    assert encoder.encoded <= len(cut) + 1 and encoder.reused >= 2 * len(cut)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" a'sZ1\n\té<|endoftext> ​́"), st.characters(codec="utf-8")), max_size=60), st.integers(0, 4))
def test_any_text_at_any_cuts(text, bits):
    import numpy as np

    raw = text.encode()
    at = [i for i in range(1, len(raw)) if raw[i] & 0xC0 != 0x80 and i % (bits + 1) == 0]
    got = bpe.ChunkEncoder(PATH, 1 << 10).ids(raw, at)
    assert got.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert bpe.codec(PATH).decode(got.tolist()) == LIBRARY.decode(got.tolist(), skip_special_tokens=False)
