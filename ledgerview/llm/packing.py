"""Packing by cutting-stock column generation.

Documents are tokenized once. One that fits a sequence stays whole; only longer ones are cut, into full sequences and a
remainder. A remainder, cut already, is cut on into half a sequence, a multiple of GRAIN tokens and fewer than GRAIN, which
gives patterns their small parts. Only where whole documents cannot be combined with less than MOST_PADDING of
padding (say, all a little over half a sequence) every document is cut like a remainder. The histogram of lengths, at most `capacity` numbers whatever the corpus, goes to
the driver. There a linear program over patterns (multisets of lengths that fit a sequence) is solved by revised simplex, from a basis of greedy patterns;
an unbounded knapsack dynamic program prices new patterns until the bound on what is left to gain is under GAP. Copies of
patterns are rounded down and the few pieces left over are packed best-fit. Pieces get a rank within their length; the
rank says which copy of which pattern, and which place in it, a piece takes.

Ranks are made in two steps (within a hash chunk of a length, then offsets of chunks), so a length that a third of
all pieces share is still spread over many tasks.

Defined cases: a null text is empty; a document without tokens still has its end token and so one piece. Repeated
rows are packed one by one. Null doc_ids stay null. Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerview.llm import textbuf
from ledgerview.llm.common import cut, drop_cut, prepare

CAPACITY, GRAIN, END_ID = 1024, 64, 0
MOST_PADDING = 0.02
GAP, MOST_PRICINGS = 0.001, 4000
CHUNK_ROWS, MOST_CHUNKS = 20_000, 16_384
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Scripts for which both encoders below are known to split alike; other texts go to the slower one.
LATIN_END = 0x250

_encoders: dict[str, object] = {}


def encoder(json_name: str, ranks_name: str):
    """A function text -> numpy array of ids, as the tokenizers library gives them for json_name."""
    if json_name not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(public_tokenizers.path(json_name))
        special = [t.content for t in slow.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(ranks_name), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def ids(text: str) -> np.ndarray:
            if (text.isascii() or max(text) < chr(LATIN_END)) and not any(x in text for x in special):
                return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

        _encoders[json_name] = ids
    return _encoders[json_name]


def spans(tokens: int, capacity: int = CAPACITY, whole: bool = True) -> Iterator[tuple[int, int]]:
    """Where a document is cut: nowhere if it fits and is to stay whole; else full sequences, a half, a multiple of GRAIN below it, and what is left."""
    if whole and 0 < tokens <= capacity:
        yield 0, tokens
        return
    at = 0
    while at < tokens:
        left = tokens - at
        grain = min(GRAIN, capacity)
        size = capacity if left >= capacity else capacity // 2 if left >= capacity // 2 > 0 else left // grain * grain or left
        yield at, at + size
        at += size


def cut_pieces(docs: DataFrame, json_name: str, ranks_name: str, capacity: int = CAPACITY, whole: bool = True) -> DataFrame:
    """The pieces of every document of docs(doc_id, text)."""
    prepare(docs.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_name, ranks_name)
        for batch in batches:
            text = textbuf.strings(batch.column(1))
            for lo, hi in textbuf.slices(text):
                which, start, length, crc, total = [], [], [], [], []
                for k in range(lo, hi):
                    found = np.append(encode(text[k].as_py()), np.uint32(END_ID)).astype("<u4")
                    for at, to in spans(len(found), capacity, whole):
                        part = found[at:to]
                        which.append(k)
                        start.append(at)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        total.append(len(found))
                ids = batch.column(0).take(pa.array(which, pa.int64())).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(pieces, PIECES)


def price(lengths: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best pattern for the values of lengths (in order): unbounded knapsack by dynamic programming."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if fits[c]:
            gain = best[c - lengths[: fits[c]]] + value[: fits[c]]
            k = int(gain.argmax())
            if gain[k] > best[c]:
                best[c], took[c] = gain[k], k
    pattern, c = np.zeros(len(lengths), np.int64), capacity
    while c > 0:
        if took[c] >= 0:
            pattern[took[c]] += 1
            c -= lengths[took[c]]
        else:
            c -= 1
    return float(best[capacity]), pattern


def first_basis(lengths: np.ndarray, need: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A feasible basis: the pattern of the longest pieces left that fit, as often as they last, until none are left.

    Each pattern uses up a length that no later one has, so the columns, put at these lengths, are independent.
    """
    basis, x = np.diag(capacity // lengths).astype(float), np.zeros(len(lengths))
    left, open_ = need.copy(), list(range(len(lengths)))
    while open_:
        pattern, room, k = np.zeros(len(lengths)), capacity, len(open_)
        while k := min(k, bisect_right(open_, room, key=lambda at: lengths[at])):
            at = open_[k - 1]
            pattern[at] = min(room // lengths[at], max(1, int(left[at])))
            room -= int(pattern[at] * lengths[at])
            k -= 1
        used = np.flatnonzero(pattern)
        ratio = left[used] / pattern[used]
        out = used[ratio.argmin()]
        left[used] -= ratio.min() * pattern[used]
        basis[:, out], x[out] = pattern, ratio.min()
        left[out] = 0
        open_ = [at for at in open_ if left[at] > 1e-9]
    return basis, x


def column_generation(counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Patterns and fractional copies that cover counts (index: length) with few sequences."""
    lengths = np.flatnonzero(counts)
    need = counts[lengths].astype(float)
    m = len(lengths)
    if not m:
        return []
    basis, x = first_basis(lengths, need, capacity)
    inverse = np.linalg.inv(basis)
    least = float((lengths * need).sum()) / capacity
    for k in range(MOST_PRICINGS):
        if k % 200 == 199:  # keep rounding errors small
            inverse = np.linalg.inv(basis)
            x = np.maximum(inverse @ need, 0)
        total = x.sum()
        if total <= least * (1 + GAP):
            break
        worth, pattern = price(lengths, inverse.sum(axis=0), capacity)
        if worth <= 1 + 1e-9 or total / worth >= total * (1 - GAP):
            break
        column = pattern.astype(float)
        move = inverse @ column
        ratio = np.where(move > 1e-9, x / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = np.maximum(x - step * move, 0)
        x[out] = step
        row = inverse[out] / move[out]
        inverse -= np.outer(move, row)
        inverse[out] = row
        basis[:, out] = column
    found = []
    for k in range(m):
        pattern = np.zeros(capacity + 1, np.int64)
        pattern[lengths] = np.rint(basis[:, k]).astype(np.int64)
        found.append((pattern, float(x[k])))
    return found


def best_fit(counts: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Patterns, one sequence each, for the pieces left over: longest first, each where least room stays."""
    rooms: list[tuple[int, int]] = []
    made: list[np.ndarray] = []
    for length in np.flatnonzero(counts)[::-1].tolist():
        for _ in range(int(counts[length])):
            k = bisect_left(rooms, (length, -1))
            if k < len(rooms):
                room, which = rooms.pop(k)
            else:
                room, which = capacity, len(made)
                made.append(np.zeros(capacity + 1, np.int64))
            made[which][length] += 1
            if room > length:
                insort(rooms, (room - length, which))
    return made


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[dict[str, np.ndarray], int]:
    """Slots by length: from rank `first` on, `each` places a copy at offset `place` in sequences from `base` on; and the number of sequences."""
    left = counts.astype(np.int64).copy()
    chosen: list[tuple[np.ndarray, int]] = []
    for pattern, copies in sorted(column_generation(counts, capacity), key=lambda p: -p[1]):
        used = np.flatnonzero(pattern)
        n = min(int(copies + 1e-6), int((left[used] // pattern[used]).min()) if len(used) else 0)
        if n > 0:
            chosen.append((pattern, n))
            left -= n * pattern
    chosen += [(pattern, 1) for pattern in best_fit(left, capacity)]
    rows: list[tuple[int, int, int, int, int]] = []
    ranks, base = np.zeros(capacity + 1, np.int64), 0
    for pattern, n in chosen:
        place = 0
        for length in np.flatnonzero(pattern)[::-1].tolist():
            each = int(pattern[length])
            rows.append((length, int(ranks[length]), each, place, base))
            ranks[length] += n * each
            place += each * length
        base += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "each", "place", "base"), table.T, strict=True)), base


def _ranked(pieces: DataFrame) -> DataFrame:
    spark = pieces.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = min(MOST_CHUNKS, max(1 + pieces.count() // CHUNK_ROWS, 4 * parts))
    dealt = pieces.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(chunks)))
    sizes = dealt.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(sizes.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "length-offsets")
    own = Window.partitionBy("length", "chunk").orderBy("doc_id", "start", "ids_crc32")
    return dealt.withColumn("own", F.row_number().over(own)).join(offsets, ["length", "chunk"]).withColumn("rank", F.col("offset") + F.col("own") - 1)


def pack(docs: DataFrame, json_name: str, ranks_name: str, capacity: int = CAPACITY) -> DataFrame:
    """PIECES with sequence_id and offset."""
    for whole in (True, False):
        pieces = cut(cut_pieces(docs, json_name, ranks_name, capacity, whole), "pieces")
        counts = np.zeros(capacity + 1, np.int64)
        for length, n in pieces.groupBy("length").count().collect():  # at most `capacity` rows
            counts[length] = n
        slots, sequences = plan(counts, capacity)
        if not whole or (sequences - 1) * capacity * (1 - MOST_PADDING) <= int(counts @ np.arange(capacity + 1)):
            break
        drop_cut(pieces)
    keys = (slots["length"] << np.int64(44)) + slots["first"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 5))
            at = np.searchsorted(keys, (length << np.int64(44)) + rank, side="right") - 1
            rel, each = rank - slots["first"][at], slots["each"][at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(slots["base"][at] + rel // each), pa.array(slots["place"][at] + rel % each * length)], [*batch.schema.names[:5], "sequence_id", "offset"])

    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    return _ranked(pieces).select(*names, F.col("rank").cast("long")).mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), "byte_bpe_50k.json", "byte_bpe_50k.tiktoken")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all documents with their sequences."""
    return pack(docs, "byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
