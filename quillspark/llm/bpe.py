"""Byte-level BPE of whole documents, with content-defined chunks encoded once and joins repaired.

1. A rolling hash over 16 bytes cuts every text where its low bits are zero, so equal passages are cut alike
   wherever they stand.  The least chunk hash of a text is its route: texts that share most chunks (copies,
   near copies) tend to the same route and so to the same task.  The exchange is a rebalance on the route; a
   route with very many rows is split by the adaptive planner, which costs reuse and nothing else.
2. A task encodes a chunk once and keeps the result, up to a bound of bytes.
3. The tokens of a chunk depend on its neighbours only near its ends.  A *safe point* is a single space between
   two ASCII letters: whatever surrounds it, the pre-tokenizer ends a word before that space, and no special
   token holds one.  So only the part between a chunk's first and last safe point is reused; the join of two
   chunks, from the last safe point of one to the first of the next, is encoded again as one string.  A chunk
   without a safe point agrees with nothing by itself: the join grows over it to the next chunk that has one.

Results equal those of the tokenizers library with the same file.  Merges run in tiktoken if the file's merges
are in the order of their ids, which is tested on loading, and in the tokenizers library otherwise.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordarrays import _BYTE_BASE, _BYTE_INVERSE, _powers, mix, slices, text_buffer

WINDOW = 16
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for U+0100 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Codec:
    """encode(str) -> uint32 array, decode(list of ids) -> str, as the tokenizers library does."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        byte = _byte_of_char()
        special = {t["content"]: t["id"] for t in added}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"].get(a + b) for a, b in pairs]
        plain = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        plain = plain and all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or any(map(str.isspace, t["content"]))) for t in added)
        plain = plain and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        self.size = max([*model["vocab"].values(), *special.values()], default=0) + 1
        self.fast = plain and None not in made and made == sorted(set(made)) and len(made) + 256 + len(added) == len(model["vocab"] | special)
        if self.fast:
            import tiktoken

            ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
            core = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)
            self.encode = lambda text: core.encode_to_numpy(text, allowed_special="all")
            self.decode = lambda ids: core.decode_bytes(ids).decode("utf-8", "replace")
        else:
            from tokenizers import Tokenizer

            core = Tokenizer.from_file(path)
            core.no_truncation()
            core.no_padding()
            self.encode = lambda text: np.array(core.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
            self.decode = lambda ids: core.decode(ids, skip_special_tokens=False)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def cuts_of(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Chunk starts in ``data`` (those of the texts included), and the hash before each; never inside a character."""
    n = len(data)
    if n <= WINDOW:
        cut, value = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    else:
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BYTE_BASE, n), out=total[1:])
        h = mix((total[WINDOW:n] - total[: n - WINDOW]) * _powers(_BYTE_INVERSE, n)[: n - WINDOW])
        cut = np.flatnonzero((h & np.uint64((1 << bits) - 1)) == 0)
        cut = cut[(data[cut + WINDOW] & 0xC0) != 0x80]
        value = h[cut]
        cut = cut + WINDOW
        inside = cut - offsets[np.searchsorted(offsets, cut, side="right") - 1] >= WINDOW  # no window over two texts
        cut, value = cut[inside], value[inside]
    return cut, value


def safe_points(chunk: bytes) -> tuple[int, int] | None:
    """The first and the last safe point, or None."""
    a = np.frombuffer(chunk, dtype=np.uint8)
    at = np.flatnonzero((a[1:-1] == 32) & _LETTER[a[:-2]] & _LETTER[a[2:]]) + 1 if len(a) > 2 else a[:0]
    return (int(at[0]), int(at[-1])) if len(at) else None


class ChunkEncoder:
    """Encodes texts chunk by chunk; keeps up to ``bound`` bytes of chunks, older ones go first."""

    def __init__(self, path: str, bound: int = 8 << 20):
        self.codec, self.bound = codec(path), bound
        self.young: dict[bytes, tuple] = {}
        self.old: dict[bytes, tuple] = {}
        self.size = self.reused = self.encoded = 0

    def _piece(self, chunk: bytes) -> tuple:
        """(head, ids of the middle, tail), or None where there is no safe point."""
        got = self.young.get(chunk)
        if got is None:
            got = self.old.get(chunk)
            if got is None:
                points = safe_points(chunk)
                first, last = points or (0, 0)
                got = (chunk[:first], self.codec.encode(chunk[first:last].decode()), chunk[last:]) if points else (None, None, None)
                self.encoded += 1
            else:
                self.reused += 1
            self.size += len(chunk)
            if self.size > self.bound // 2:
                self.old, self.young, self.size = self.young, {}, len(chunk)
            self.young[chunk] = got
        else:
            self.reused += 1
        return got

    def ids(self, text: bytes, cuts: list[int]) -> np.ndarray:
        out, pending = [], []
        for at, to in zip([0, *cuts], [*cuts, len(text)]):
            chunk = text[at:to]
            head, middle, tail = self._piece(chunk)
            if head is None:
                pending.append(chunk)
                continue
            pending.append(head)
            out.append(self.codec.encode(b"".join(pending).decode()))
            out.append(middle)
            pending = [tail]
        out.append(self.codec.encode(b"".join(pending).decode()))
        return np.concatenate(out)


def _routes(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            data, offsets = text_buffer(batch.column("text"))
            cut, value = cuts_of(data, offsets, bits)
            route = np.zeros(batch.num_rows, dtype=np.uint64)
            first = np.searchsorted(cut, offsets)
            some = first[:-1] < first[1:]
            if some.any():
                route[some] = np.minimum.reduceat(value, first[:-1][some])
            # a text of one chunk goes where its first bytes send it
            for i in np.flatnonzero(~some).tolist():
                route[i] = int.from_bytes(hashlib.blake2b(data[offsets[i] : offsets[i + 1]].tobytes(), digest_size=8).digest(), "big")
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in batch.schema.names} | {"route": pa.array(mix(route).view(np.int64))})

    return run


def _encode(path: str, bits: int, bound: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(path, bound)
        number = [str(i) for i in range(encoder.codec.size)]
        for batch in slices(batches, "text", 1 << 20):
            data, offsets = text_buffer(batch.column("text"))
            cut, _ = cuts_of(data, offsets, bits)
            first = np.searchsorted(cut, offsets)
            n_tokens, ids_sha, decoded_sha, ids = [], [], [], []
            for i in range(batch.num_rows):
                at, to = int(offsets[i]), int(offsets[i + 1])
                own = encoder.ids(data[at:to].tobytes(), (cut[first[i] : first[i + 1]] - at).tolist())
                listed = own.tolist()
                n_tokens.append(len(listed))
                ids_sha.append(hashlib.sha256(",".join([number[t] for t in listed]).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(encoder.codec.decode(listed).encode()).hexdigest())
                if with_ids:
                    ids.append(own)
            columns = {"doc": batch.column("doc"), "n_tokens": pa.array(n_tokens, pa.int64()), "ids_sha256": pa.array(ids_sha), "decoded_sha256": pa.array(decoded_sha)}
            if with_ids:
                ends = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
                columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))
            yield pa.RecordBatch.from_pydict(columns)

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, bits: int = 8, bound: int = 8 << 20, with_ids: bool = True) -> DataFrame:
    """(doc, n_tokens, ids_sha256, decoded_sha256, and ids array<int> if with_ids) for every row of ``docs``.

    Null and empty texts have no tokens.  Null ids and repeated rows stay.  ``bits`` sets the mean length of
    chunks, 2^bits bytes.  decoded_sha256 is of the text decoded from the ids.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    routed = d.mapInArrow(_routes(bits), "doc long, text string, route long").hint("rebalance", "route")
    kinds = "doc long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return routed.select("doc", "text").mapInArrow(_encode(path or default_path(), bits, bound, with_ids), kinds)


def decode(tokens: DataFrame, ids_col: str = "ids", out_col: str = "text", path: str | None = None) -> DataFrame:
    """``tokens`` with the text of its ids added; null ids give a null text."""
    path = path or default_path()

    @F.pandas_udf("string")
    def text_of(ids):
        c = codec(path)
        return ids.map(lambda x: None if x is None else c.decode(x.tolist()))

    return tokens.withColumn(out_col, text_of(F.col(ids_col)))
