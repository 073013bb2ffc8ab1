"""Token counts by a compiled finite-state transducer.

The byte-pair vocabulary is compiled, one transition at a time as texts ask for them, into a deterministic transducer
over characters. A state holds, for each suffix of the text so far that a longer piece could still grow from, the
piece that ends before that suffix and how many pieces fewer or more there were then. A piece may follow another
only if the merges of both together give just these two; that makes the last piece of every prefix unique, so each
transition has one next state and one number of tokens to add.

A text is cut into chunks of CHUNK characters. From its first synchronising position (a word start, or after a
character outside the vocabulary) a chunk runs from the start state, whatever came before; all chunks of a slice run
in step. A chunk's map from entry to exit state is then a constant after a short head. Neighbouring chunks without such a
position (long texts without spaces) have maps, filled in for the states that are asked for, which compose by a parallel
prefix scan in a number of rounds that depends on the states met at chunk bounds, not on the length of the text.

Defined cases: a null text is empty; an empty text has 0 bytes and 0 tokens. Texts are whole, of any length. Repeated
rows keep their rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerview.llm import textbuf
from ledgerview.llm.common import prepare

CHUNK, LIMIT = 256, 4096
#: A worker drops its compiled states, or its known pairs of pieces, between slices beyond these numbers.
MOST_STATES, MOST_PAIRS = 250_000, 1_000_000
#: States a chunk's map is asked for before the chunks composed so far are set aside.
MOST_ASKED = 32
START = 0
_NONE = -1


class Transducer:
    """Compiled transitions (state, character class) -> (state, tokens), kept in an open-addressing table."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.encode(" x", out_type=str)[0] != "▁":
            raise ValueError("only models without normalisation and with a leading space are supported")
        ids = [k for k in range(model.get_piece_size()) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))]
        self.pieces = [model.id_to_piece(k) for k in ids]
        self.rank = {p: model.get_score(k) for p, k in zip(self.pieces, ids, strict=True)}
        self.number = {p: k for k, p in enumerate(self.pieces)}
        if any("▁" in p.lstrip("▁") for p in self.pieces):
            raise ValueError("pieces must have spaces at their beginning only")
        letters = sorted({c for p in self.pieces for c in p})
        letters = [c for c in letters if c in self.rank]
        #: Classes: 0 to 3 for characters outside the vocabulary by their UTF-8 length, then one for each letter.
        self.classes = np.zeros(0x110000, np.int32)
        self.classes[0x80:0x800], self.classes[0x800:0x10000], self.classes[0x10000:] = 1, 2, 3
        for k, c in enumerate(letters):
            self.classes[ord(c)] = 4 + k
        self.space = int(self.classes[0x2581])
        self.classes[32] = self.space
        self.letters = letters
        self.width = 4 + len(letters)
        self._trie()
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def _trie(self) -> None:
        code = {c: 4 + k for k, c in enumerate(self.letters)}
        self.child: list[dict[int, int]] = [{}]
        self.ends = [_NONE]
        for k, p in enumerate(self.pieces):
            at = 0
            if all(c in code for c in p):
                for c in p:
                    at = self.child[at].setdefault(code[c], len(self.child))
                    if at == len(self.child):
                        self.child.append({})
                        self.ends.append(_NONE)
                self.ends[at] = k
        self.word_end = [p[-1] != "▁" for p in self.pieces]

    def reset(self) -> None:
        self.states: dict[tuple, int] = {((0, _NONE, 0),): START}
        self.entries: list[tuple] = [((0, _NONE, 0),)]
        self.used = 0
        self._table(1 << 16)

    def _table(self, size: int) -> None:
        self.keys = np.full(size, -1, np.int64)
        self.to = np.zeros(size, np.int32)
        self.emit = np.zeros(size, np.int16)
        self.mask = size - 1

    def _fits(self, a: int, b: int) -> bool:
        """Whether the merges of piece a before piece b leave just a and b (a may be none)."""
        known = self.fits.get((a, b))
        if known is None:
            left = "" if a == _NONE else self.pieces[a]
            symbols, rank = [*left, *self.pieces[b]], self.rank
            while len(symbols) > 1:
                best = max(((rank.get(x + y, -np.inf), -k) for k, (x, y) in enumerate(zip(symbols, symbols[1:], strict=False))))
                if best[0] == -np.inf:
                    break
                k = -best[1]
                symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            known = self.fits[a, b] = symbols == ([left, self.pieces[b]] if left else [self.pieces[b]])
        return known

    def _compile(self, state: int, cls: int) -> tuple[int, int]:
        if cls < 4:
            return START, cls + 1
        live, last, delta = [], _NONE, 0
        for node, before, rel in self.entries[state]:
            if before != _NONE and node == 0 and cls == self.space and self.word_end[before]:
                before = _NONE  # a word start: nothing before it matters
            at = self.child[node].get(cls)
            if at is None:
                continue
            if last == _NONE and self.ends[at] != _NONE and self._fits(before, self.ends[at]):
                last, delta = self.ends[at], rel + 1
            if self.child[at]:
                live.append((at, before, rel))
        if last == _NONE:
            raise ValueError("the vocabulary has no unique segmentation")
        found = (*((at, before, rel - delta) for at, before, rel in live), (0, last, 0))
        to = self.states.setdefault(found, len(self.entries))
        if to == len(self.entries):
            self.entries.append(found)
        return to, delta

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) & self.mask

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of keys, and which of them are there."""
        slot = self._slot(keys)
        held = self.keys[slot]
        wrong = np.flatnonzero((held != keys) & (held != -1))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & self.mask
            held[wrong] = again = self.keys[slot[wrong]]
            wrong = wrong[(again != keys[wrong]) & (again != -1)]
        return slot, held == keys

    def _put(self, key: int, to: int, emit: int) -> None:
        slot = int(self._slot(np.array([key], np.int64))[0])
        while self.keys[slot] != -1:
            slot = (slot + 1) & self.mask
        self.keys[slot], self.to[slot], self.emit[slot] = key, to, emit
        self.used += 1
        if 2 * self.used > len(self.keys):
            old = [(int(k), int(t), int(e)) for k, t, e in zip(self.keys, self.to, self.emit, strict=True) if k != -1]
            self._table(4 * len(self.keys))
            self.used = 0
            for x in old:
                self._put(*x)

    def step(self, state: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = state.astype(np.int64) * self.width + cls
        slot, there = self._find(keys)
        if not there.all():
            for key in np.unique(keys[~there]).tolist():
                self._put(key, *self._compile(*divmod(key, self.width)))
            slot, _ = self._find(keys)
        return self.to[slot], self.emit[slot]

    def run(self, cls: np.ndarray, start: np.ndarray, stop: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and token counts of many stretches, all of them in step."""
        order = np.argsort(start - stop, kind="stable")
        at, state, length = start[order], state[order].astype(np.int32), (stop - start)[order]
        count = np.zeros(len(order), np.int64)
        running = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0))
        for t, n in enumerate(running):
            state[:n], more = self.step(state[:n], cls[at[:n] + t])
            count[:n] += more
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return state[back], count[back]

    @staticmethod
    def _open_runs(constant: np.ndarray) -> list[tuple[int, int]]:
        """Bounds of the runs of chunks whose maps are not constant; the chunk before a run is."""
        edges = np.diff(np.concatenate([[0], ~constant, [0]]).astype(np.int8))
        return list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))

    def _scan(self, cls: np.ndarray, lo: np.ndarray, hi: np.ndarray, state: int) -> tuple[int, np.ndarray, np.ndarray]:
        """States at the bounds of neighbouring chunks, the first one given, and the count of each chunk.

        The first number says how many chunks are composed; it is all of them unless MOST_ASKED states do not suffice.

        A chunk's map holds the entry states asked of it so far. Maps are composed by doubling: after k steps a place
        says where its state is 2^k chunks on. While the composition from `state` meets a state that a chunk does not
        know, every chunk behind is asked for that state and for the exit its predecessor gave last, all in step.
        """
        n = len(lo)
        enter, leave, count = np.full((n, 1), state, np.int32), np.empty((n, 0), np.int32), np.empty((n, 0), np.int64)
        at = 0  # chunks before it are composed
        while True:
            for column in range(leave.shape[1], enter.shape[1]):
                out, more = self.run(cls, lo[at:], hi[at:], enter[at:, column])
                leave = np.column_stack([leave, np.append(np.full(at, -1, np.int32), out)])
                count = np.column_stack([count, np.append(np.zeros(at, np.int64), more)])
            # the place in the next chunk's map that each exit leads to; the last place of all is "not known"
            k = enter.shape[1]
            same = leave[:-1, :, None] == enter[1:, None, :]
            to = np.where(same.any(axis=2), (np.arange(1, n) * k)[:, None] + same.argmax(axis=2), n * k)
            jump = np.concatenate([to.ravel(), np.full(k + 1, n * k)])
            path = np.array([0])  # places of chunks 0, 1, ... from the first entry of chunk 0
            while len(path) < n:
                path = np.append(path, jump[path])
                jump = jump[jump]
            path = path[:n]
            at = int(np.searchsorted(path, n * k))
            if at == n or k > MOST_ASKED:
                known = np.minimum(path, n * k - 1)
                return at, np.append(state, leave.ravel()[known]), count.ravel()[known]
            front = leave.ravel()[path[at - 1]]
            guess = np.append(np.full(1, front, np.int32), leave[:-1, -1])
            guess[: at + 1] = front
            enter = np.column_stack([enter, np.full(n, front, np.int32), guess])

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text of a large_string array without nulls."""
        if len(self.entries) > MOST_STATES:
            self.reset()
        if len(self.fits) > MOST_PAIRS:
            self.fits.clear()
        chars = [np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in texts.to_pylist()]
        size = np.array([len(x) + 1 if len(x) else 0 for x in chars])
        begin = np.cumsum(size) - size
        cls = np.empty(size.sum(), np.int32)
        for b, x in zip(begin, chars, strict=True):
            if len(x):
                cls[b] = self.space
                cls[b + 1 : b + 1 + len(x)] = self.classes[x]
        if not len(cls):
            return np.zeros(len(size), np.int64)
        sync = np.zeros(len(cls), bool)
        sync[1:] = (cls[:-1] < 4) | (cls[1:] == self.space) & (cls[:-1] != self.space)
        filled = size > 0
        sync[begin[filled]] = True
        # chunks: from every text's begin, every CHUNK characters
        per = -(-size[filled] // CHUNK)
        doc = np.repeat(np.flatnonzero(filled), per)
        lo = begin[doc] + CHUNK * (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per))
        hi = np.minimum(lo + CHUNK, (begin + size)[doc])
        marks = np.flatnonzero(sync)
        first = np.append(marks, len(cls))[np.searchsorted(marks, lo)]
        constant = first < hi
        body = np.where(constant, first, hi)
        leave, count = self.run(cls, body, hi, np.full(len(lo), START, np.int32))
        enter = np.append(START, leave).astype(np.int32)
        runs = self._open_runs(constant)
        heads = np.array([a for a, _ in runs], np.int64)  # the first chunks of all runs go in step; most runs have no other
        enter[heads + 1], count[heads] = self.run(cls, lo[heads], hi[heads], enter[heads])
        for a, b in runs:
            a += 1
            while a < b:
                done, enter[a : b + 1], count[a:b] = self._scan(cls, lo[a:b], hi[a:b], enter[a])
                a += done
        heads = np.flatnonzero(constant & (body > lo))
        count[heads] += self.run(cls, lo[heads], body[heads], enter[heads])[1]
        return np.bincount(doc, count, len(size)).astype(np.int64)


_compiled: dict[str, Transducer] = {}
_libraries: dict[str, object] = {}


def transducer(path: str) -> Transducer:
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def library_counts(path: str, texts: list[str]) -> list[int]:
    """Tokens of each text as the library itself counts them."""
    if path not in _libraries:
        import sentencepiece

        _libraries[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return [len(x) for x in _libraries[path].encode(texts)]


def count_tokens(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs(doc_id, text); model: a file name of public_tokenizers."""
    prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        machine = transducer(public_tokenizers.path(model))
        for batch in batches:
            text = textbuf.strings(batch.column(1))
            for lo, hi in textbuf.slices(text):
                part = text.slice(lo, hi - lo)
                try:
                    n = pa.array(machine.counts(part), pa.int64())
                except ValueError:  # a text without a unique segmentation: the library counts this slice
                    n = pa.array(library_counts(public_tokenizers.path(model), part.to_pylist()), pa.int64())
                size = pa.compute.binary_length(part).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(pa.int64()), size, n], ["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), "piece_bpe_32k.model")
