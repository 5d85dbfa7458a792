"""Language-model scoring by Ziv-Merhav cross-parsing, without training a model.

A document is factored greedily: the next phrase is the longest run of its words that occurs in a reference text
(one word, if even that doesn't).  With c phrases over n words, a reference of r words and the c0 phrases of the
document's own LZ78 parse, the relative entropy in bits per word is ``(c * log2(r) - c0 * log2(c0)) / n`` (Ziv and
Merhav 1993, with r in place of n where the two texts differ in length).  Low: the document reads like the reference.
The reference of a corpus is the corpus itself without the document, so scores are held out and need no second table.

``search_all`` takes longest matches from suffix automata: a task holds the automaton of some ``slab`` bytes of
documents and streams all reference texts through it.  That is exact for any length, and its work is the product of
both sides: right for a given reference, out of reach for a corpus against itself.

``corpus_parse`` is for the corpus against itself, in work and shuffle that grow with the corpus, and exact as well: it
looks runs of words up among the runs of all other texts.

* Texts are packed in batches of about ``batch`` bytes, words as 64-bit hashes.  A batch sends every distinct hash of
  its runs to the bucket of that hash; a hash that came from two batches is shared, and a bit for each goes back.
  Inside a batch, a run of two texts is shared as well.  Distinct texts are in one batch each, so no text meets itself.
* Runs of 1 to 8 words are all looked up, in three phases.  A run can only be shared if all shorter ones in it are: each
  phase sends what the phase before left, some 0.75, 0.5 and 0.45 hashes a word.
* Matches of over 8 words lie in passages, stretches of places where runs of 8 are shared.  The place where the longest
  match ends never falls from one place to the next, so it is held between two bounds for every place, and one answer
  settles many places.  A round asks for some runs (place, length): first each passage whole, then a grid of places and
  ends between the bounds.  An asked length goes by the run of 8 it starts with to all places that have this run; they
  and the asker look their runs of that length up as before.  Rounds go on until no bounds differ, and after the second
  with no other places than those that start like one with open bounds.
* A hot word, passage or text is one hash for each batch; buckets are uniform.  Copies of a text are parsed once.
* Every phase is written to the shared folder, where tasks read packed texts; a lost executor repeats its tasks of one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pyarrow.parquet
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialise, release
from .wordarrays import joined, mix, rolled, slices, words_of

_OUT = "doc_id long, n_words long, phrases long, own_phrases long, longest int, reference_words long, score double"

#: Lengths that a phrase can have: every one, these and longer ones.
LENGTHS = np.arange(1, 1 << 12)
#: Lengths of each phase; the first of a phase is looked for where all of the phase before was found.
PHASES = [(1, 2), (3, 4), (5, 6, 7, 8)]
SHORT = PHASES[-1][-1]
#: Places and ends of a grid that a round asks for, where a passage as a whole isn't shared.
GRID = 8
_PACK = "batch long, tids binary, meta binary, words binary, ids binary"
_LEVELS = "batch long, file string, bucket int, bits binary, level binary"
_PASSAGES = "batch long, file string, bucket int, at binary, low binary, high binary, left long, words binary, texts binary"


class SuffixAutomaton:
    """Of a sequence of non-negative ints; a state's first transition is kept in lists, others in dictionaries."""

    __slots__ = ("link", "length", "token", "target", "more", "last")

    def __init__(self) -> None:
        self.link, self.length, self.token, self.target = [-1], [0], [-1], [-1]
        self.more: dict[int, dict[int, int]] = {}
        self.last = 0

    def extend(self, tokens: list[int]) -> None:
        link, length, token, target, more = self.link, self.length, self.token, self.target, self.more
        last = self.last
        for c in tokens:
            new = len(link)
            length.append(length[last] + 1)
            link.append(0)
            token.append(-1)
            target.append(-1)
            p = last
            while p >= 0:
                t = token[p]
                if t == c:
                    q = target[p]
                    break
                if t < 0:
                    token[p], target[p] = c, new
                elif (d := more.get(p)) is None:
                    more[p] = {c: new}
                elif (q := d.get(c)) is not None:
                    break
                else:
                    d[c] = new
                p = link[p]
            if p >= 0:
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(link)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    token.append(token[q])
                    target.append(target[q])
                    if q in more:
                        more[copy] = dict(more[q])
                    while p >= 0:
                        if token[p] == c:
                            if target[p] != q:
                                break
                            target[p] = copy
                        else:
                            d = more[p]
                            if d[c] != q:
                                break
                            d[c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        self.last = last


class Slab:
    """Documents, and for each state of their automaton the longest match of any streamed text and of another one.

    A state stands for the strings of some end; a text matches it with a length, and its suffix links in full.
    """

    def __init__(self, texts: dict[str, bytes]) -> None:
        self.own = {key: i for i, key in enumerate(texts)}
        self.ids: dict[bytes, int] = {}
        self.automaton = SuffixAutomaton()
        self.tokens = [[self.ids.setdefault(w, len(self.ids) + 1) for w in t.split()] for t in texts.values()]
        for tokens in self.tokens:
            self.automaton.extend(tokens + [0])
        n = len(self.automaton.link)
        self.best, self.source, self.second = [0] * n, [-1] * n, [0] * n
        self.seen = len(texts)

    def stream(self, key: str | None, text: bytes) -> None:
        """Each text once; ``key`` is its key among the documents, None if it is none of them."""
        a = self.automaton
        link, length, token, target, more = a.link, a.length, a.token, a.target, a.more
        best, source, second = self.best, self.source, self.second
        x = self.own.get(key, self.seen)
        self.seen += x == self.seen
        get = self.ids.get
        run = state = 0
        for w in text.split():
            c = get(w)
            if c is None:
                run = state = 0
                continue
            while True:
                if token[state] == c:
                    state = target[state]
                    run += 1
                    break
                d = more.get(state)
                q = d.get(c) if d else None
                if q is not None:
                    state = q
                    run += 1
                    break
                state = link[state]  # ends at the root, which has every known word
                run = length[state]
            if source[state] == x:
                if run > best[state]:
                    best[state] = run
            elif run > best[state]:
                second[state], best[state], source[state] = best[state], run, x
            elif run > second[state]:
                second[state] = run

    def settle(self) -> None:
        """Hand what was matched on to the suffix links, once all texts are streamed."""
        link, length = self.automaton.link, self.automaton.length
        best, source, second = self.best, self.source, self.second
        for v in sorted(range(1, len(link)), key=length.__getitem__, reverse=True):
            p = link[v]
            if not best[v] or not p:
                continue
            if second[v]:
                second[p] = length[p]
            elif source[p] != source[v]:
                second[p] = max(second[p], best[p])
            best[p], source[p] = length[p], source[v]

    def phrases(self, i: int) -> tuple[int, int]:
        """(number of phrases, length of the longest) of the greedy parse of document i by all texts but itself."""
        a = self.automaton
        best, source, second = self.best, self.source, self.second
        count = longest = phrase = run = state = 0
        for c in self.tokens[i]:
            state = a.target[state] if a.token[state] == c else a.more[state][c]
            run += 1
            while state and not (most := best[state] if source[state] != i else second[state]):
                state = a.link[state]
                run = a.length[state]
            run = min(run, most) if state else 0  # the longest match that ends with this word
            if phrase and run <= phrase:  # doesn't reach back to where the phrase starts
                count, longest, phrase = count + 1, max(longest, phrase), 0
            if run:
                phrase += 1
            else:
                count, longest = count + 1, max(longest, 1)
        return (count + 1, max(longest, phrase)) if phrase else (count, longest)


def own_phrases(tokens: list[int], distinct: int) -> int:
    """Phrases of the LZ78 parse of tokens in range(distinct)."""
    trie: dict[int, int] = {}
    node = count = 0
    for c in tokens:
        key = node * distinct + c
        child = trie.get(key)
        if child is None:
            count += 1
            trie[key] = count
            node = 0
        else:
            node = child
    return count + (node > 0)


def _score(n: int, count: int, c0: int, r: int) -> float:
    return (count * math.log2(max(r, 2)) - c0 * math.log2(c0)) / n if n else 0.0


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones, and so on: what is zero throughout is left to compression."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _from_planes(raw: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(size, -1).T).view(dtype).ravel()


def _order(keys: np.ndarray) -> np.ndarray:
    """An order that brings equal keys together: a sort of their high bits with the place in the low ones.

    Much faster than a sort of places; where high bits of different keys agree (rare), it is one.  Equal keys keep their order.
    """
    bits = np.uint64(max(1, int(len(keys) - 1).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    order = (np.sort((keys & ~low) | np.arange(len(keys), dtype=np.uint64)) & low).astype(np.int64)
    s = keys[order]
    if (((s[1:] ^ s[:-1]) <= low) & (s[1:] != s[:-1])).any():
        return np.argsort(keys, kind="stable")
    return order


def _dictionary(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, the frequent ones first so that high halves of their numbers are zero, and the number of each."""
    order = _order(h)
    s = h[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] != s[:-1]
    start = np.flatnonzero(new)
    often = np.argsort(-np.diff(np.append(start, len(s))), kind="stable")
    number = np.empty(len(start), dtype=np.uint32)
    number[often] = np.arange(len(start), dtype=np.uint32)
    ids = np.empty(len(h), dtype=np.uint32)
    ids[order] = number[np.cumsum(new) - 1]
    return s[start][often], ids


def _pack(size: int):
    """Distinct texts to batches: their keys, facts, distinct word hashes, and words as places in those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        for rows in slices(batches, "text", size):
            w = words_of(rows.column("text"))
            known, ids = _dictionary(w.hashes())
            counts = np.diff(w.first)
            meta = np.zeros((rows.num_rows, 3), dtype=np.int64)
            meta[:, 0], meta[:, 1] = counts, rows.column("copies").to_numpy(zero_copy_only=False)
            for i, (a, b) in enumerate(zip(w.first.tolist(), w.first[1:].tolist())):
                meta[i, 2] = own_phrases(ids[a:b].tolist(), len(known))
            made = [b"".join(bytes.fromhex(t) for t in rows.column("tid").to_pylist()), meta.tobytes(), known.tobytes(), _planes(ids)]
            yield pa.RecordBatch.from_arrays([pa.array([part << 32 | serial], pa.int64()), *(pa.array([x], pa.binary()) for x in made)], names=["batch", "tids", "meta", "words", "ids"])
            serial += 1

    return run


class _Packs:
    """Packed batches out of their files; the last file is kept, as rows come by batch."""

    def __init__(self) -> None:
        self.file = None

    def __call__(self, row: dict) -> dict:
        if row["file"] != self.file:
            self.file = row["file"]
            self.table = pa.parquet.read_table(self.file.removeprefix("file:"), use_threads=False)
            self.at = {b: i for i, b in enumerate(self.table.column("batch").to_pylist())}
        return self.table.slice(self.at[row["batch"]], 1).to_pylist()[0]


def _texts(pack: dict) -> tuple[np.ndarray, np.ndarray]:
    """(words, copies, own phrases) of a batch's texts, and where each starts."""
    meta = np.frombuffer(pack["meta"], dtype=np.int64).reshape(-1, 3)
    return meta, np.concatenate([[0], np.cumsum(meta[:, 0])])


def _edges(runs: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's runs start."""
    limits = np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(runs, limits), [len(runs)]])


def _distinct_runs(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts g, where each distinct hash starts in it, and the number of the distinct hash of each g."""
    order = _order(g)
    s = g[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] != s[:-1]
    which = np.empty(len(g), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), which


def _sent(batch: int, runs: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    edges = _edges(runs, buckets)
    full = np.flatnonzero(np.diff(edges))
    if len(full):
        yield pa.RecordBatch.from_arrays(
            [pa.array(full.astype(np.int32)), pa.array(np.full(len(full), batch)), pa.array([_planes(np.diff(runs[edges[k] : edges[k + 1]], prepend=np.uint64(0))) for k in full.tolist()], pa.binary())], names=["bucket", "batch", "runs"]
        )


def _with_answers(shared: np.ndarray, edges: np.ndarray, answers: list[dict]) -> np.ndarray:
    shared = shared.copy()
    for x in answers:
        k = x["bucket"]
        n = int(edges[k + 1] - edges[k])
        shared[edges[k] : edges[k + 1]] |= np.unpackbits(np.frombuffer(x["bits"], dtype=np.uint8), count=n).astype(bool)
    return shared


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows come by batch, those of no bucket first."""
    held: list[dict] = []
    for rows in batches:
        for row in rows.to_pylist():
            if held and held[-1]["batch"] != row["batch"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _row(schema: str, **values: object) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([values.get(n)], kinds[k]) for n, k in fields], names=[n for n, _ in fields])


class _Batch:
    """A packed batch and the distinct runs of words that a phase looks up."""

    def __init__(self, row: dict, pack: dict):
        self.row, self.pack = row, pack
        self.meta, self.first = _texts(pack)
        self.level = np.frombuffer(row["level"], dtype=np.uint8).copy() if row["level"] else np.zeros(self.first[-1], dtype=np.uint8)

    def look_up(self, phase: int) -> None:
        """hashes: of each run; parts: (length, places, first text, last text) of those of each length in turn.

        Single words are looked up once each: their place is the number of the word.
        """
        self.ids = _from_planes(self.pack["ids"], np.uint32)
        known = np.frombuffer(self.pack["words"], dtype=np.uint64)
        h, n = known[self.ids], len(self.ids)
        place = np.arange(n)
        text = np.repeat(np.arange(len(self.meta), dtype=np.int32), self.meta[:, 0])
        hashes, self.parts = [np.zeros(0, dtype=np.uint64)], []
        if phase == 0:
            reach = self.first[text + 1] - place
            first, last = np.zeros((2, len(known)), dtype=np.int32)
            last[self.ids], first[self.ids[::-1]] = text, text[::-1]
            hashes.append(rolled(known, 1))
            self.parts.append((1, np.arange(len(known)), first, last))
        else:
            base = PHASES[phase - 1][-1]
            found = self.level >= base
            after = np.minimum.accumulate(np.where(found, n, place)[::-1])[::-1]  # the next place where it ends
            reach = np.where(found, after - place + base - 1, 0)
            edge = np.zeros(n + base, dtype=np.int32)
            at = np.flatnonzero(found)
            edge[at] += 1
            edge[at + base] -= 1
            place = np.flatnonzero(np.cumsum(edge[:n]))  # words of passages that go on
            h, reach = h[place], reach[place]
        for length in PHASES[phase]:
            at = np.flatnonzero(reach >= length) if length > 1 else place[:0]
            if length > 1 and len(at):
                hashes.append(rolled(h, length)[at])
                self.parts.append((length, place[at], text[place[at]], text[place[at]]))
        self.hashes = np.concatenate(hashes)

    def runs(self) -> np.ndarray:
        """Sorted distinct hashes."""
        g = np.sort(self.hashes)
        return g[np.append(True, g[1:] != g[:-1])[: len(g)]]

    def settle(self, buckets: int, answers: list[dict]) -> None:
        if not len(self.hashes):
            return
        order = _order(self.hashes)
        g = self.hashes[order]
        new = np.append(True, g[1:] != g[:-1])
        start = np.flatnonzero(new)
        low, high = (np.concatenate([x[k] for x in self.parts]) for k in (2, 3))
        shared = low[order[start]] != high[order[np.append(start[1:], len(g)) - 1]]  # places rise within a run
        shared = _with_answers(shared, _edges(g[start], buckets), answers)
        hit = np.empty(len(g), dtype=bool)
        hit[order] = np.repeat(shared, np.diff(np.append(start, len(g))))
        at = 0
        for length, places, _, _ in self.parts:  # in rising order
            found = hit[at : at + len(places)]
            if length == 1:
                np.maximum(self.level, found.view(np.uint8)[self.ids], out=self.level)
            else:
                self.level[places[found]] = length
            at += len(places)


def _send(phase: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = _Packs()
        for rows in batches:
            for row in rows.to_pylist():
                b = _Batch(row, packs(row))
                b.look_up(phase)
                yield from _sent(row["batch"], b.runs(), buckets)

    return run


def _meet(buckets: int):
    """Rows come by bucket; of each batch's runs, a bit for those that some other batch has sent as well."""

    def answer(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        runs = [np.cumsum(_from_planes(r, np.uint64), dtype=np.uint64) for _, _, r in rows]
        g = np.concatenate(runs)
        order = _order(g * np.uint64(buckets))  # one to one within a bucket, and uniform
        s = g[order]
        same = s[1:] == s[:-1]
        found = np.zeros(len(g), dtype=bool)
        found[order[1:]] = same
        found[order[:-1]] |= same
        ends = np.cumsum([len(r) for r in runs])
        bits = [np.packbits(part).tobytes() for part in np.split(found, ends[:-1])]
        return pa.RecordBatch.from_arrays([pa.array([b for _, b, _ in rows], pa.int64()), pa.array([k for k, _, _ in rows], pa.int32()), pa.array(bits, pa.binary())], names=["batch", "bucket", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        for rows in batches:
            for row in zip(rows.column("bucket").to_pylist(), rows.column("batch").to_pylist(), rows.column("runs").to_pylist()):
                if held and held[-1][0] != row[0]:
                    yield answer(held)
                    held = []
                held.append(row)
        if held:
            yield answer(held)

    return run


def _settle(phase: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = _Packs()
        for row, *answers in _grouped(batches):
            b = _Batch(row, packs(row))
            b.look_up(phase)
            b.settle(buckets, answers)
            yield _row(_LEVELS, batch=row["batch"], file=row["file"], bucket=-1, level=b.level.tobytes())

    return run


class _Passages:
    """Places of a batch where runs of SHORT words are shared; low, high: bounds of where the longest match from each ends."""

    def __init__(self, row: dict, packs: _Packs):
        self.row = row
        self.at = np.cumsum(_from_planes(row["at"], np.uint32), dtype=np.int64)
        self.low = self.at + _from_planes(row["low"], np.uint32)
        self.high = self.low + _from_planes(row["high"], np.uint32)
        start, size = self.spans(np.arange(len(self.at)))
        offset = np.cumsum(size) - size
        self.place = self.at + (offset - start)[np.searchsorted(start, self.at, side="right") - 1]  # among the words of all
        if row["words"] is None:
            pack = packs(row)
            meta, first = _texts(pack)
            self.text = np.searchsorted(first, self.at, side="right") - 1
            self.copied = meta[self.text, 1] != 0
            ids = _from_planes(pack["ids"], np.uint32)[np.repeat(start - offset, size) + np.arange(size.sum())]
            words = np.frombuffer(pack["words"], dtype=np.uint64)[ids]
        else:
            words, text = np.frombuffer(row["words"], dtype=np.uint64), _from_planes(row["texts"], np.uint32)
            self.text, self.copied = text >> 1, (text & 1) != 0
        self.joins = [words]

    def spans(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the stretches of words that matches from these places may have."""
        at, high = self.at[index], self.high[index]  # both never fall
        first = np.flatnonzero(np.append(True, at[1:] >= high[:-1])[: len(at)])
        return at[first], high[np.append(first[1:], len(at)) - 1] - at[first] if len(at) else high

    def hashes(self, index: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Of as many words from at[index], as ``rolled`` puts them together."""
        out, have = np.zeros(len(index), dtype=np.uint64), np.zeros(len(index), dtype=np.int64)
        for e in range(int(length.max(initial=0)).bit_length()):
            if e == len(self.joins):
                self.joins.append(joined(self.joins[-1][: -(1 << e - 1)], self.joins[-1][1 << e - 1 :]))
            at = np.flatnonzero(length >> e & 1)
            piece = self.joins[e][self.place[index[at]] + length[at] - have[at] - (1 << e)]
            out[at] = np.where(have[at] > 0, joined(piece, out[at]), piece)
            have[at] += 1 << e
        return mix(out)

    def present(self) -> None:
        """starts: sorted distinct hashes of SHORT words that a longer match may start with; holders: all their places."""
        self.holders = np.flatnonzero(self.high - self.at > SHORT)
        g = self.hashes(self.holders, np.full(len(self.holders), SHORT))
        self.order, self.first, self.which = _distinct_runs(g)
        self.starts = g[self.order[self.first]]

    def open(self) -> np.ndarray:
        return np.flatnonzero((self.low < self.high) & ~self.copied)

    def asks(self, grid: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and lengths to ask for: of each group of open places with like bounds, its first one and its end at least."""
        o = self.open()
        new = np.ones(len(o), dtype=bool)
        new[1:] = (np.diff(o) > 1) | (np.diff(self.high[o]) > 0) | (np.diff(self.low[o]) > 1)
        start = np.flatnonzero(new)
        width = np.diff(np.append(start, len(o)))
        high = self.high[o[start]]
        room = high - self.low[o[start]]
        across, down = np.minimum(grid, width), np.minimum(grid, room)
        index, ends = [o[:0]], [high[:0]]
        for i in range(grid):
            for j in range(grid):
                k = np.flatnonzero((i < across) & (j < down))
                at = o[start[k] + i * (width[k] - 1) // np.maximum(across[k] - 1, 1)]
                end = high[k] - j * room[k] // down[k]
                index.append(at[end > self.low[at]])
                ends.append(end[end > self.low[at]])
        index = np.concatenate(index)
        return index, np.concatenate(ends) - self.at[index]

    def supply(self, buckets: int, asked: list[dict]) -> None:
        """The runs of all lengths asked for, at all places where they may be shared; marked: holders that some open place may match."""
        edges = _edges(self.starts, buckets)
        none = np.zeros(0, dtype=np.int64)
        run = np.concatenate([none, *(_from_planes(x["index"], np.uint32) + edges[x["bucket"]] for x in asked)])
        length = np.concatenate([none, *(_from_planes(x["lengths"], np.uint32).astype(np.int64) for x in asked)])
        marked = np.zeros(len(self.starts), dtype=bool)
        marked[run[length == 0]] = True
        self.marked = self.holders[marked[self.which]]
        run, length = run[length > 0], length[length > 0]
        often = np.diff(np.append(self.first, len(self.order)))[run]
        index = self.holders[self.order[np.repeat(self.first[run] - np.cumsum(often) + often, often) + np.arange(often.sum())]]
        length = np.repeat(length, often)
        fits = self.at[index] + length <= self.high[index]
        self.index, self.length = index[fits], length[fits]
        g = self.hashes(self.index, self.length)
        order, start, self.which = _distinct_runs(g)
        self.runs = g[order[start]]
        text = self.text[self.index][order]
        self.shared = np.minimum.reduceat(text, start) != np.maximum.reduceat(text, start) if len(start) else np.zeros(0, dtype=bool)

    def settle(self, shared: np.ndarray) -> None:
        hit = shared[self.which]
        end = self.at[self.index] + self.length
        np.maximum.at(self.low, self.index[hit], end[hit])
        np.minimum.at(self.high, self.index[~hit], end[~hit] - 1)
        self.low = np.maximum.accumulate(self.low)  # later passages end later
        self.high = np.minimum.accumulate(self.high[::-1])[::-1]

    def packed(self, index: np.ndarray | None = None, bucket: int = -1) -> Iterator[pa.RecordBatch]:
        """All places, or those of index with their words; -2 as the bucket: with nothing but where matches end."""
        k = np.arange(len(self.at)) if index is None else index
        if len(k):
            at, low, high = (_planes(x.astype(np.uint32)) for x in (np.diff(self.at[k], prepend=0), (self.low - self.at)[k], (self.high - self.low)[k]))
            words = texts = None
            if bucket == -2:
                high = None
            elif index is not None:
                start, size = self.spans(k)
                base = self.place[k][np.searchsorted(self.at[k], start)]
                words = self.joins[0][np.repeat(base - np.cumsum(size) + size, size) + np.arange(size.sum())].tobytes()
                texts = _planes((self.text * 2 + self.copied)[k].astype(np.uint32))
            yield _row(_PASSAGES, batch=self.row["batch"], file=self.row["file"], bucket=bucket, at=at, low=low, high=high, left=int(((self.low < self.high) & ~self.copied)[k].sum()), words=words, texts=texts)


def _begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packs = _Packs()
    for rows in batches:
        for row in rows.to_pylist():
            at = np.flatnonzero(np.frombuffer(row["level"], dtype=np.uint8) == SHORT)
            if len(at):
                last = np.append(np.diff(at) > 1, True)
                end = at[np.flatnonzero(last)[np.cumsum(last) - last]] + SHORT
                row |= {"at": _planes(np.diff(at, prepend=0).astype(np.uint32)), "low": _planes(np.full(len(at), SHORT, dtype=np.uint32)), "high": _planes((end - at - SHORT).astype(np.uint32)), "words": None}
                yield from _Passages(row, packs).packed()


def _ask(grid: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = _Packs()
        for rows in batches:
            for row in rows.to_pylist():
                p = _Passages(row, packs)
                p.present()
                index, lengths = p.asks(grid)
                if grid > 1:  # a length of 0 marks the places that are of use to the open ones
                    index, lengths = np.append(index, p.open()), np.append(lengths, np.zeros(len(p.open()), dtype=np.int64))
                run = p.which[np.searchsorted(p.holders, index)]
                order = np.argsort(run, kind="stable")
                run, lengths = run[order].astype(np.uint32), lengths[order].astype(np.uint32)
                edges = _edges(p.starts, buckets)
                cuts = np.searchsorted(run, edges)
                for sent in _sent(row["batch"], p.starts, buckets):
                    full = sent.column("bucket").to_pylist()
                    made = [[_planes(run[cuts[k] : cuts[k + 1]] - np.uint32(edges[k])) for k in full], [_planes(lengths[cuts[k] : cuts[k + 1]]) for k in full]]
                    yield pa.RecordBatch.from_arrays([*sent.columns, *(pa.array(x, pa.binary()) for x in made)], names=["bucket", "batch", "runs", "index", "lengths"])

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket; to each batch, the lengths that any batch asks of the runs it has."""

    def answer(rows: list[tuple[int, int, bytes, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        runs = [np.cumsum(_from_planes(r, np.uint64), dtype=np.uint64) for _, _, r, _, _ in rows]
        h = np.concatenate([r[_from_planes(x[3], np.uint32)] for r, x in zip(runs, rows)])
        m = np.concatenate([_from_planes(x[4], np.uint32) for x in rows])
        if not len(h):
            return
        order = np.lexsort((m, h))
        h, m = h[order], m[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (m[1:] != m[:-1])
        h, m = h[new], m[new]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        h, often = h[first], np.diff(np.append(first, len(m)))
        for g, x in zip(runs, rows):
            at = np.minimum(np.searchsorted(g, h), len(g) - 1)
            k = np.flatnonzero(g[at] == h)
            if len(k):
                n = often[k]
                lengths = m[np.repeat(first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                made = [_planes(np.repeat(at[k], n).astype(np.uint32)), _planes(lengths)]
                yield pa.RecordBatch.from_arrays([pa.array([x[1]], pa.int64()), pa.array([x[0]], pa.int32()), *(pa.array([y], pa.binary()) for y in made)], names=["batch", "bucket", "index", "lengths"])

    held: list[tuple[int, int, bytes, bytes, bytes]] = []
    for rows in batches:
        for row in zip(*(rows.column(c).to_pylist() for c in ("bucket", "batch", "runs", "index", "lengths"))):
            if held and held[-1][0] != row[0]:
                yield from answer(held)
                held = []
            held.append(row)
    if held:
        yield from answer(held)


def _supply(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = _Packs()
        for row, *asked in _grouped(batches):
            if asked:
                p = _Passages(row, packs)
                p.present()
                p.supply(buckets, asked)
                yield from _sent(row["batch"], p.runs, buckets)

    return run


def _narrow(grid: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = _Packs()
        for row, *rest in _grouped(batches):
            p = _Passages(row, packs)
            keep = np.zeros(len(p.at), dtype=bool)
            if rest:
                p.present()
                p.supply(buckets, [x for x in rest if x["bits"] is None])
                p.settle(_with_answers(p.shared, _edges(p.runs, buckets), [x for x in rest if x["bits"] is not None]))
                keep[p.marked] = True
            if grid > 1:
                yield from p.packed(np.flatnonzero(keep))
                yield from p.packed(np.flatnonzero(~keep), -2)
            else:
                yield from p.packed()

    return run


def _parse(total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = _Packs()
        for both in _grouped(batches):
            row = next(x for x in both if x["level"] is not None)
            b = _Batch(row, packs(row))
            step = np.maximum(b.level, 1).astype(np.int64)
            for x in both:
                if x["at"] is not None:
                    step[np.cumsum(_from_planes(x["at"], np.uint32), dtype=np.int64)] = _from_planes(x["low"], np.uint32)
            out = []
            for t, (a, (n, copied, c0)) in enumerate(zip(b.first.tolist(), b.meta.tolist())):
                if copied:
                    count, longest = (1 if n else 0), n
                else:
                    steps, p, count, longest = step[a : a + n].tolist(), 0, 0, 0
                    while p < n:
                        d = steps[p]
                        if d > longest:
                            longest = d
                        p += d
                        count += 1
                r = total if copied else total - n
                out.append((b.pack["tids"][16 * t : 16 * t + 16].hex(), n, count, c0, longest, r, _score(n, count, c0, r)))
            names = ["tid", "n_words", "phrases", "own_phrases", "longest", "reference_words", "score"]
            kinds = [pa.string()] + [pa.int64()] * 3 + [pa.int32(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return run


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return d.withColumn("tid", F.md5(F.col("text").cast("binary")))


def _distinct(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(tid, text, copies): whether several ids have the text; a null id is one id."""
    i = F.col("doc_id")
    several = (F.min(i) != F.max(i)) | ((F.count(i) > 0) & (F.count(i) < F.count(F.lit(1))))
    return _rows(df, id_col, text_col).groupBy("tid").agg(F.first("text").alias("text"), F.coalesce(several, F.lit(False)).alias("copies"))


def corpus_parse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: int = 2 << 20, bucket: int = 1 << 21) -> DataFrame:
    """(doc_id, n_words, phrases, own_phrases, longest, reference_words, score) for every row of ``docs``.

    Words are runs of other bytes than ASCII white space, unchanged.  A document is every row of its id and text, and
    not its own reference; a text that several ids have is found whole.  Null and empty texts have no words and score
    0; null ids are one id; repeated rows stay; an empty table gives none.  Equality is by MD5 for texts, by 64-bit
    hashes for runs of words.  ``batch`` is in bytes of text, ``bucket`` in words of the corpus for each bucket.
    """
    if batch < 1 or bucket < 1:
        raise ValueError("batch and bucket must be positive")
    spark = docs.sparkSession
    packs = materialise(_distinct(docs, id_col, text_col).mapInArrow(_pack(batch), _PACK), "lm-packs")
    release(spark)
    part = F.shiftrightunsigned("batch", 32).cast("int")
    total, parts = packs.agg(F.sum(F.octet_length("ids") / 4), F.max(part)).first()
    total, parts = int(total or 0), 1 + (parts or 0)
    buckets = max(1, math.ceil(total / bucket))

    def by_bucket(df: DataFrame) -> DataFrame:
        return df.repartition("bucket").sortWithinPartitions("bucket")

    def by_batch(df: DataFrame, *others: DataFrame) -> DataFrame:
        for x in others:
            df = df.unionByName(x, allowMissingColumns=True)
        return df.repartitionById(parts, part).sortWithinPartitions("batch", "bucket")

    def replaced(made: DataFrame, name: str, *before: DataFrame) -> DataFrame:
        made = materialise(made, name)
        release(spark)
        for x in before:
            discard(x)
        return made

    levels = materialise(packs.select("batch", F.col("_metadata.file_path").alias("file"), F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("bits"), F.lit(b"").alias("level")), "lm-levels")
    for phase in range(len(PHASES)):
        sent = by_bucket(levels.mapInArrow(_send(phase, buckets), "bucket int, batch long, runs binary"))
        answers = replaced(sent.mapInArrow(_meet(buckets), "batch long, bucket int, bits binary"), "lm-answers")
        levels = replaced(by_batch(levels, answers).mapInArrow(_settle(phase, buckets), _LEVELS), f"lm-phase{phase}", levels, answers)
    passages = materialise(levels.mapInArrow(_begin, _PASSAGES), "lm-passages")
    grid, buckets, done = 1, math.ceil(buckets / 4), []
    while passages.agg(F.sum("left")).first()[0]:
        sent = by_bucket(passages.mapInArrow(_ask(grid, buckets), "bucket int, batch long, runs binary, index binary, lengths binary"))
        asked = replaced(sent.mapInArrow(_asked, "batch long, bucket int, index binary, lengths binary"), "lm-asked")
        sent = by_bucket(by_batch(passages, asked).mapInArrow(_supply(buckets), "bucket int, batch long, runs binary"))
        answers = replaced(sent.mapInArrow(_meet(buckets), "batch long, bucket int, bits binary"), "lm-answers")
        after = replaced(by_batch(passages, asked, answers).mapInArrow(_narrow(grid, buckets), _PASSAGES), "lm-passages", asked, answers)
        if grid == 1:
            discard(passages)
        else:
            done.append(after.filter("bucket = -2"))
        passages, grid = after.filter("bucket = -1"), GRID
    facts = by_batch(levels, passages, *done).mapInArrow(_parse(total), _OUT.replace("doc_id long", "tid string"))
    return _rows(docs, id_col, text_col).select("doc_id", "tid").join(facts, "tid").drop("tid")


def cross_entropy(docs: DataFrame, reference: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of ``docs`` by all of ``reference``, or by the corpus itself; columns and cases as in ``corpus_parse``."""
    return corpus_parse(docs, id_col, text_col) if reference is None else search_all(docs, reference, id_col, text_col)


def _search_slabs(files: list[str], slab: int, total: int, own: bool):
    def references() -> Iterator[tuple[str, bytes]]:
        if not files:
            return
        for batch in pa.dataset.dataset(files, format="parquet").to_batches(columns=["tid", "text"], batch_size=512, batch_readahead=1, fragment_readahead=1):
            yield from zip(batch.column("tid").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist())

    def search(texts: dict[str, bytes], shared: set[str]) -> pa.RecordBatch:
        s = Slab({k: t for k, t in texts.items() if k not in shared})
        if s.own:
            for key, text in references():
                s.stream(key if own else None, text)
            s.settle()
        out = []
        for key, text in texts.items():
            words = text.split()
            n = len(words)
            count, longest = (1 if n else 0, n) if key in shared else s.phrases(s.own[key])
            r = total - n if own and key not in shared else total
            ids: dict[bytes, int] = {}
            c0 = own_phrases([ids.setdefault(w, len(ids)) for w in words], n + 1)
            out.append((key, n, count, c0, longest, r, _score(n, count, c0, r)))
        names = ["tid", "n_words", "phrases", "own_phrases", "longest", "reference_words", "score"]
        kinds = [pa.string()] + [pa.int64()] * 3 + [pa.int32(), pa.int64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, shared, size = {}, set(), 0
        for batch in batches:
            for key, copies, text in zip(batch.column("tid").to_pylist(), batch.column("copies").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                if texts and size + len(text) > 2 * slab:
                    yield search(texts, shared)
                    texts, shared, size = {}, set(), 0
                texts[key] = text
                if own and copies:
                    shared.add(key)
                else:
                    size += len(text)
        if texts:
            yield search(texts, shared)

    return run


def search_all(docs: DataFrame, reference: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", slab: int = 2 << 20) -> DataFrame:
    """The columns of ``corpus_parse``, each phrase searched in every text of ``reference``, or of the corpus.

    In the corpus a document is every row of its id and text, and not its own reference; a text that several ids have
    is found whole.  Equal reference texts count once in ``reference_words``.  Null ids are one id here; null and
    empty texts have no words and score 0; repeated rows stay.  Equality of texts is by MD5.  A text of over ``slab``
    bytes is a slab of its own.
    """
    if slab < 1:
        raise ValueError("slab must be positive")
    words = r"[^ \t\n\x0B\f\r]+"

    def counted(df: DataFrame) -> DataFrame:
        return materialise(_distinct(df, id_col, text_col).withColumn("n", F.regexp_count("text", F.lit(words)).cast("long")), "lm-texts")

    d = counted(docs)
    held = d if reference is None else counted(reference)
    total = held.agg(F.sum("n")).first()[0] or 0
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = sorted(f.removeprefix("file://") for f in held.inputFiles())
    slabs = d.repartition(max(1, math.ceil(size / slab)), "tid").select("tid", "copies", "text")
    facts = slabs.mapInArrow(_search_slabs(files, slab, total, reference is None), _OUT.replace("doc_id long", "tid string"))
    return _rows(docs, id_col, text_col).select("doc_id", "tid").join(facts, "tid").drop("tid")
