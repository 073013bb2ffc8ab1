"""Fuzzy line dedup: prefix filter over rare words, edit similarity, one occurrence for each connected group.

Lines are normalised (ASCII lower case, every digit as 0, white space squeezed). Equal normalised lines are one node.
Two lines are similar if the edit distance over their words is at most a fifth of the longer one's words, so only lines of at least
LEAST_WORDS words can be similar and not equal. Candidates come from the pigeonhole principle on words in place of SimHash
bits: similar lines share all but a fifth of their words, so in any order of all words the first floor(n / 5) + L words
of both lines have their first L shared words among them (prefix filter; repeated words are numbered). Lines of up to
SHORT words show their rare words of this kind as keys, and pairs of their common ones, so that a key meets few lines.
Longer lines, and those that can be similar to one, show all words of this kind, a key for every five words. So the
candidates are complete for lines of all lengths. The order puts rare words first, by counts over all documents. Pairs that meet are dropped early only by bounds that no similar pair
exceeds: a differing number of words, a differing place of the word they meet by, and two bits of a parity signature an edit.
Keys travel packed, in buckets of bounded size and PASSES parts, so that Spark moves few rows and a key takes 22 to 84 bytes.
Pairs that stay are verified by edit distance over their
words (each a letter of LETTERS), and verified pairs are linked; of every connected group the first occurrence in
(doc_id, line) order stays.

A shard with many near pairs first sends only one or two of each member. After these links are verified, a second pass compares
and verifies within such shards just the members that are not connected yet, and sends a spanning forest of the new
links; so no link between groups is lost, and a tight group of thousands of variants never makes all its pairs.

Texts of the few lines that must be compared are read in a second scan through a bitmap.

Defined cases: a null text stays null; blank lines are neither compared nor removed. Lines are told apart by doc_id, text and
number, so differing texts of one doc_id lose only their own repeats; of rows equal in doc_id and text one counts as the
first. Rows with a null doc_id stay as they are and take no part. A document that loses all its lines stays with an
empty text (or blank lines). All other columns stay; n_lines and n_removed of the input are replaced.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerview.llm import textbuf
from ledgerview.llm.common import cut, drop_cut, prepare
from ledgerview.llm.components import components, contracted
from ledgerview.llm.simhash_dedup import MOST_HOT, hot_keys

SIMILARITY, LEAST_WORDS = 0.8, 4  # four words are similar to the same and one more
#: Lines of up to SHORT words show pairs in place of their common words; lines of at least 0.8 * SHORT words show single words, also common ones; so similar lines have one kind in common.
SHORT = 30
#: Words are common above this rank: some 280 occurrences in the corpus.
COMMON = 48
#: Entries of the table of word counts, and steps of a rank for each power of two; both only order the words.
RANKS, STEPS = 1 << 20, 6
#: One of how many documents tells which shards are cut; that never changes what is compared.
HOT_SAMPLE = 16
#: Lines whose words are sorted at a time (their number takes 20 bits), and members of a shard compared at a time.
SORTED, COMPARED = 1 << 20, 256
#: Most pairs compared at a time, whatever the size of a shard: memory stays bounded.
CELLS = 1 << 19
#: Shards of up to LEAF members are compared all at a time; a shard of more than FEW members may have DENSE near pairs a member.
LEAF, FEW, DENSE = 64, 16, 4
#: A parity signature has 64 bits for lines of up to LEVELS[0] words, then twice as many a level: some one and a half bits a word or more up to 340 words, so that hardly any of others' lines differ in as little as an edit's share.
LEVELS = (45, 80, 160)
#: Numbers of 64 bits of the longest signature.
SIGNS = 1 << len(LEVELS)
#: A key as it travels, for lines of up to that many words: its hash within the bucket, the line, its words, the place of the key's word (the highest number: none), parities.
_FORMS = [
    (most, np.dtype([("key", "<u4"), ("h", "<i8"), ("words", size), ("place", size), *((f"s{k}", "<i8") for k in range(signs))]))
    for most, size, signs in (*((most, "u1", 1 << k) for k, most in enumerate((*LEVELS, 254))), (1 << 62, "<u4", SIGNS))
]
#: Keys that a task holds before it packs them, and about as many as a bucket has.
HELD = 1 << 20
#: Parts of all keys that travel one after the other, so that the disk holds one of them at a time; the texts are read once for each.
PASSES = 2
#: Parts in which the members of a group meet its first occurrence.
SALTS = 16
#: Pairs for each line with a text that are verified at a time: each travels with a text, so disk follows the texts, not the pairs.
LOT = 2
#: Letters that stand for words when lines are verified, from FIRST_LETTER on.
LETTERS, FIRST_LETTER = 1_000_000, 0x10000
#: Most bits of the map through which the second scan picks lines, 4 MB at the driver at any size; it has 32 bits a line below that. A full map picks more lines, and the join that follows drops them.
MAP_BITS = 1 << 25
_NORMAL = textbuf.lower_ascii(np.arange(256, dtype=np.uint8))
_NORMAL[48:58] = 48


def lines_of(column: pa.Array) -> dict[str, np.ndarray]:
    """For every line that has a word: row, line (number in its text), h, words, and its span first:last in the hashes of all words."""
    data, offsets = textbuf.raw(column)
    data = _NORMAL[data]
    breaks = np.flatnonzero(data == 10)
    lo, hi = np.sort(np.concatenate([offsets[:-1], breaks + 1])), np.sort(np.concatenate([breaks, offsets[1:]]))
    per = np.diff(np.searchsorted(breaks, offsets)) + 1
    row = np.repeat(np.arange(len(per)), per)
    line = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    starts, ends, _ = textbuf.bounds(data, offsets)
    first, last = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
    keep = last > first
    row, line, first, last = (x[keep] for x in (row, line, first, last))
    hashes = textbuf.span_hashes(data, starts, ends)
    h = textbuf.sequence_hashes(hashes, first, last)
    return {"hashes": hashes, "first": first, "last": last, "row": row, "line": line, "h": h.view(np.int64), "words": last - first}


def _signs(values: np.ndarray, begin: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Parity signatures of runs of values: which of the numbers 0 to 64 * SIGNS - 1 occur an odd number of times.

    Column 0 is the sum (exclusive or) of all numbers of 64 bits; columns k to 2 k - 1, for each power of two k, are the
    upper half of the 2 k sums of numbers at the same remainder by 2 k. So a shorter signature is the beginning of a longer
    one, and lines of different lengths compare.
    """
    out = np.zeros((len(begin), SIGNS), np.int64)
    if len(begin):
        one = np.uint64(1) << (values.astype(np.uint64) & np.uint64(63))
        of = (values >> np.uint64(6)).astype(np.int64) % SIGNS
        sums = [np.bitwise_xor.reduceat(np.where(of == k, one, np.uint64(0)), begin).view(np.int64) for k in range(SIGNS)]
        for level in range(len(LEVELS), 0, -1):
            half = 1 << (level - 1)
            for k in range(half):
                out[:, half + k] = np.where(words > LEVELS[level - 1], sums[half + k], 0)
            sums = [sums[k] ^ sums[half + k] for k in range(half)]
        out[:, 0] = sums[0]
    return out


def _placed_keys(hashes: np.ndarray, words: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """line, key, place of the key's (first) word, -1 if the line has that word twice: all keys that the prefix filter asks for.

    Of two similar lines, a word that either has twice is shared as often as both have it, any other one if the edits keep it;
    these are as many as the prefix filter asks for, so lines also meet by a word that stands at places no edits rule out.
    """
    lines, found, places = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    ends = np.concatenate([[0], np.cumsum(words)])
    for lo in range(0, len(words), SORTED):
        size = words[lo : lo + SORTED]
        own = hashes[ends[lo] : ends[lo + len(size)]]
        # owner, rank and hash in one number: the rarest words of each line first; words that share a number are one word
        rank = ranks[(own % np.uint64(len(ranks))).astype(np.int64)].astype(np.uint64)
        owner = np.repeat(np.arange(len(size), dtype=np.uint64), size)
        order = owner << np.uint64(44) | rank << np.uint64(36) | own >> np.uint64(28)
        stood = np.argsort(order)
        order = order[stood]
        at = np.arange(len(order))
        new = np.ones(len(order), bool)
        new[1:] = order[1:] != order[:-1]
        again = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
        item = textbuf.mix((order & np.uint64((1 << 44) - 1)) + (again << np.uint64(44)))
        common = (order >> np.uint64(36) & np.uint64(255)) > COMMON
        begin = np.cumsum(size) - size
        spare = size - np.ceil(size * SIMILARITY - 1e-9).astype(np.int64)
        of = owner.astype(np.int64)
        place = at - begin[of]
        once = new.copy()
        once[:-1] &= new[1:]
        stood = np.where(once, stood - begin[of], -1)
        single = (place <= spare[of]) & (~common | (size >= SIMILARITY * SHORT)[of])
        lines.append(of[single] + lo)
        found.append(item[single])
        places.append(stood[single])
        # the common words among the first spare + 2 are the last of these
        last = np.minimum(size, spare + 2)
        many = np.add.reduceat(common & (place < last[of]), begin) if len(begin) else begin
        many[size > SHORT] = 0
        for n in np.unique(many[many > 1]):
            some = np.flatnonzero(many == n)
            i, j = np.triu_indices(n, 1)
            where = (begin + last - n)[some][:, None] + np.arange(n)
            tail = item[where]
            lines.append(np.repeat(some, len(i)) + lo)
            found.append(textbuf.mix(tail[:, i] ^ textbuf.mix(tail[:, j] + np.uint64(1))).ravel())
            places.append(stood[where][:, i].ravel())
    return np.concatenate(lines), np.concatenate(found).view(np.int64), np.concatenate(places)


def _keys(hashes: np.ndarray, words: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) rows of _placed_keys in order of lines, each once."""
    line, key, _ = _placed_keys(hashes, words, ranks)
    order = np.lexsort((key, line))
    line, key = line[order], key[order]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (key[1:] != key[:-1])
    return line[new], key[new]


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    text = textbuf.strings(batch.column(batch.schema.get_field_index("text")))
    for lo, hi in textbuf.slices(text):
        yield lo, hi, lines_of(text.slice(lo, hi - lo))


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, th, line, h of every line; and rows without doc_id, with occurrences of words by the remainders of their hashes.

    The octets of th are the lowest octets of the counts of remainders 8 h to 8 h + 7; from h = RANKS on, th is the rest of the count of h - RANKS.
    """
    names, sums = ["doc_id", "th", "line", "h"], np.zeros(RANKS, np.int64)
    for batch in batches:
        for lo, hi, x in _parts(batch):
            sums += np.bincount((x["hashes"] % np.uint64(RANKS)).astype(np.int64), minlength=RANKS)
            own = [batch.column(k).slice(lo, hi - lo).cast(pa.int64()).take(pa.array(x["row"])) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(x["line"].astype(np.int32)), pa.array(x["h"])], names)
    low, high = (sums & 255).astype(np.uint8).view("<i8"), np.flatnonzero(sums > 255)
    few = np.flatnonzero(low)
    at, n = np.concatenate([few, high + RANKS]), np.concatenate([low[few], sums[high] & ~255])
    yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.array(n), pa.nulls(len(at), pa.int32()), pa.array(at)], names)


def _keyed(ranks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, ...]]]:
    """A function from batches of texts to line (h), words, place, the columns of its signature, and key: of every different line of a partition that can be similar to another."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for _, _, x in _parts(batch):
                h, at = np.unique(x["h"], return_index=True)
                some = (x["words"][at] >= LEAST_WORDS) & ~np.isin(h, seen, assume_unique=True)
                at = np.sort(at[some])
                seen = np.concatenate([seen, x["h"][at]])
                size = x["words"][at]
                begin = np.cumsum(size) - size
                words = x["hashes"][np.repeat(x["first"][at] - begin, size) + np.arange(size.sum())]
                of, key, place = _placed_keys(words, size, ranks.value)
                bits = _signs(words >> np.uint64(48), begin, size)
                yield x["h"][at][of], size[of], place, *bits[of].T, key

    return read


def _sampled_keys(docs: DataFrame, ranks) -> DataFrame:
    """key, once for each line of a partition that shows it."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, key in _keyed(ranks)(batches):
            yield pa.RecordBatch.from_arrays([pa.array(key)], ["key"])

    return docs.select("text").mapInArrow(keys, "key long")


def _split(hot: tuple[np.ndarray, np.ndarray], h: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, shard): the shards of each key; a hot key is cut into parts, and each pair of parts is a shard."""
    keys, parts = hot
    row = np.arange(len(key))
    if not len(keys):
        return row, key
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    many = np.where(keys[at] == key, parts[at], 1)
    if (many == 1).all():
        return row, key
    row = np.repeat(row, many)
    other = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    mine = (textbuf.mix(h.view(np.uint64)) % many.astype(np.uint64)).astype(np.int64)[row]
    pair = (np.minimum(mine, other) << 32 | np.maximum(mine, other)).astype(np.uint64)
    own = key[row].view(np.uint64)
    return row, np.where(many[row] == 1, own, textbuf.mix(own + textbuf.mix(pair))).view(np.int64)


def _packed(docs: DataFrame, ranks, hot, labels: np.ndarray, turn: int = 0, passes: int = 1) -> DataFrame:
    """bucket, form, rows: the keys of all lines that have their turn, packed as _FORMS; labels has the numbers of the buckets."""

    def pack(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        h, words, place, *bits, shard = (np.concatenate(c) for c in zip(*held, strict=True))
        own = shard.view(np.uint64)
        bucket = ((own & np.uint64(0xFFFFFFFF)) % np.uint64(len(labels))).astype(np.int64)
        least = 0
        for k, (most, form) in enumerate(_FORMS):
            at = np.flatnonzero((words > least) & (words <= most))
            at = at[np.argsort(bucket[at], kind="stable")]
            least = most
            rows = np.empty(len(at), form)
            rows["key"], rows["h"], rows["words"] = own[at] >> np.uint64(32), h[at], words[at]
            rows["place"] = np.where(place[at] < 0, np.iinfo(form["place"]).max, place[at])
            for name, b in zip(form.names[4:], bits, strict=False):
                rows[name] = b[at]
            some, first = np.unique(bucket[at], return_index=True)
            ends = pa.array(np.append(first, len(at)).astype(np.int32) * np.int32(form.itemsize))
            cells = pa.Array.from_buffers(pa.binary(), len(some), [None, ends.buffers()[1], pa.py_buffer(rows.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(labels[some]), pa.array(np.full(len(some), k, np.int32)), cells], ["bucket", "form", "rows"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for h, *more, key in _keyed(ranks)(batches):
            row, shard = _split(hot.value, h, key)
            mine = (shard.view(np.uint64) >> np.uint64(32)) % np.uint64(passes) == turn  # the other half tells the bucket
            row, shard = row[mine], shard[mine]
            # a slice of lines under hot keys may have many rows
            for lo in range(0, len(row), HELD):
                at = row[lo : lo + HELD]
                held.append((h[at], *(c[at] for c in more), shard[lo : lo + HELD]))
                n += len(at)
                if n >= HELD:
                    yield from pack(held)
                    held, n = [], 0
        if held:
            yield from pack(held)

    return docs.select("text").mapInArrow(packed, "bucket int, form int, rows binary")


def _labels(spark, parts: int, many: int) -> np.ndarray:
    """Numbers of buckets, `many` for each of as many partitions as Spark deals to by hash."""
    ids = spark.range(4 * parts * (many + 8)).select(F.col("id").cast("int").alias("id"))
    found = ids.select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("p")).toArrow()  # some numbers for each bucket
    ids, p = found["id"].to_numpy(), found["p"].to_numpy()
    order = np.lexsort((ids, p))
    ids, p = ids[order], p[order]
    return ids[np.arange(len(p)) - np.searchsorted(p, p) < many]


def _totals(counts: DataFrame) -> np.ndarray:
    """Occurrences of words for each remainder of their hashes; counts: rows without doc_id of _occurrences."""
    octets = [F.sum(F.shiftrightunsigned("th", 8 * k).bitwiseAND(F.lit(255).cast("long"))).alias(f"n{k}") for k in range(8)]
    found = counts.groupBy("h").agg(*octets).toArrow()  # at most RANKS / 8 rows, and one for each frequent remainder
    at, sums = found["h"].to_numpy(), np.stack([found[f"n{k}"].to_numpy() for k in range(8)], axis=1)
    totals, rest = np.zeros((RANKS // 8, 8), np.int64), at >= RANKS
    totals[at[~rest]] = sums[~rest]
    totals = totals.ravel()
    totals[at[rest] - RANKS] += (sums[rest] << np.arange(0, 64, 8)).sum(axis=1)
    return totals


def _ranked(totals: np.ndarray) -> np.ndarray:
    """How common words are, by steps of a STEPS-th of a power of two."""
    return np.minimum(STEPS * np.log2(totals + 1), 255).astype(np.uint8)


def _ranks(counts: DataFrame) -> np.ndarray:
    return _ranked(_totals(counts))


PAIRS = "u long, v long, shard long"


def _rows(u, v=None, shard=None) -> pa.RecordBatch:
    cells = [pa.nulls(len(u), pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (u, v, shard)]
    return pa.RecordBatch.from_arrays(cells, ["u", "v", "shard"])


def _ordered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.maximum(a, b), np.minimum(a, b)


def _whole_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first one, cut only between its values."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        if len(held[0]):
            done = int(np.searchsorted(held[0], held[0][-1]))
            if done:
                yield [x[:done] for x in held]
                held = [x[done:] for x in held]
    if held is not None and len(held[0]):
        yield held


def _aligned(place: np.ndarray, rest: np.ndarray, other: np.ndarray, left: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Whether lines may be similar and keep the word that stands at these places (-1: any) with so many words from there on: edits before and after it make up for the differences."""
    return (np.abs(place - other) + np.abs(rest - left) <= spare) | (place < 0) | (other < 0)


def _near(bits: np.ndarray, words: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether lines i and j may be similar: no similar pair fails. An edit changes the number of words by one and the parity of two bits at most."""
    most, least = np.maximum(words[i], words[j]), np.minimum(words[i], words[j])
    spare = most - np.ceil(most * SIMILARITY - 1e-9).astype(most.dtype)
    near = most - least <= spare
    at = np.flatnonzero(near)
    apart = lambda k: bits[i[at], k] ^ bits[j[at], k]
    sums = [apart(0)]
    for level in range(SIGNS.bit_length()):
        if level:  # pairs that short signatures do not tell apart, of lines that have longer ones
            long = least[at] > LEVELS[level - 1]
            at, sums = at[long], [x[long] for x in sums]
            upper = [apart(len(sums) + k) for k in range(len(sums))]
            sums = [x ^ y for x, y in zip(sums, upper, strict=True)] + upper
        if not len(at):
            break
        met = sum(np.bitwise_count(x.view(np.uint64)).astype(np.int64) for x in sums) <= 2 * spare[at]
        near[at[~met]] = False
        at, sums = at[met], [x[met] for x in sums]
    return near


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """shard, h, words, place, bits of the keys of one bucket after the other, sorted by shard, words and h; a line comes once."""

    def opened(held: list[list[memoryview]]) -> list[np.ndarray]:
        parts: list[list[np.ndarray]] = [[] for _ in range(4)]
        bits = np.zeros((sum(len(x) for rows in held for x in rows) // _FORMS[0][1].itemsize, SIGNS), np.int64)
        n = 0
        for rows, (_, form) in zip(held, _FORMS, strict=True):
            some = np.frombuffer(b"".join(rows), form)
            place = some["place"].astype(np.int64)
            place[some["place"] == np.iinfo(form["place"]).max] = -1
            for k, name in enumerate(form.names[4:]):
                bits[n : n + len(some), k] = some[name]
            n += len(some)
            for part, c in zip(parts, (some["key"].astype(np.int64), some["h"], some["words"].astype(np.int64), place), strict=True):
                part.append(c)
        shard, h, words, place = (np.concatenate(c) for c in parts)
        order = np.lexsort((h, shard << 31 | np.minimum(words, (1 << 31) - 1)))
        shard, h, words, place, bits = shard[order], h[order], words[order], place[order], bits[order]
        new = np.ones(len(h), bool)
        new[1:] = (shard[1:] != shard[:-1]) | (h[1:] != h[:-1])  # a line comes once from each partition that has it
        kept = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        moved = place != place[first][kept]
        place = place[first]
        place[kept[moved]] = -1  # keys that only share a number
        return [shard[first], h[first], words[first], place, bits[first]]

    now, held = None, [[] for _ in _FORMS]
    for batch in batches:
        for bucket, form, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != now and now is not None:
                yield opened(held)
                held = [[] for _ in _FORMS]
            now = bucket
            held[form].append(rows)
    if now is not None:
        yield opened(held)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All near pairs of small shards, and of larger ones while they are few; else one or two of each member, and the members for the second pass."""
    for shard, h, words, place, bits in _buckets(batches):
        cuts = np.flatnonzero(np.diff(shard)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(shard)]])
        size = ends - starts
        of = np.repeat(np.arange(len(size)), size)
        spare, rest = words - np.ceil(words * SIMILARITY - 1e-9).astype(np.int64), words - place
        few = np.flatnonzero((size[of] <= LEAF) & (size[of] > 1))
        k, w, p, r, e, s = of[few], words[few], place[few], rest[few], spare[few], bits[few]
        left, right, at = [], [], np.arange(len(k))
        for d in range(1, LEAF):
            at = at[at < len(k) - d]
            # rows whose shard goes on that far, and not to longer lines only
            at = at[(k[at] == k[at + d]) & (w[at] >= w[at + d] - e[at + d])]
            if not len(at):
                break
            some = at[_aligned(p[at], r[at], p[at + d], r[at + d], e[at + d])]
            hit = some[_near(s, w, some, some + d)]
            left.append(few[hit])
            right.append(few[hit + d])
        left, right = np.concatenate(left or [few[:0]]), np.concatenate(right or [few[:0]])
        dense = (np.bincount(of[left], minlength=len(size)) > DENSE * size) & (size > FEW)
        hit = ~dense[of[left]]
        if hit.any():
            yield _rows(*_ordered(h[left[hit]], h[right[hit]]))
        for lo, hi in zip(starts[dense | (size > LEAF)], ends[dense | (size > LEAF)], strict=True):
            own, many, sign = h[lo:hi], words[lo:hi], bits[lo:hi]
            stood, after, most = (x[lo:hi].astype(np.int32) for x in (place, rest, spare))
            total, lower, upper, pairs = 0, np.full(hi - lo, -1), np.full(hi - lo, -1), []
            step = max(1, min(COMPARED, CELLS // (hi - lo)))
            for x in range(0, hi - lo, step):
                y = min(x + step, hi - lo)
                stop = int(np.searchsorted(many, many[y - 1] / SIMILARITY + 1))
                hit = _aligned(stood[x:y, None], after[x:y, None], stood[None, x:stop], after[None, x:stop], most[None, x:stop])
                hit &= np.arange(x, stop)[None, :] > np.arange(x, y)[:, None]
                i, j = np.nonzero(hit)
                i, j = i + x, j + x
                met = _near(sign, many, i, j)
                i, j = i[met], j[met]
                total += len(i)
                upper[i[::-1]] = j[::-1]
                fresh = lower[j] < 0
                lower[j[fresh][::-1]] = i[fresh][::-1]
                if total <= DENSE * (hi - lo):
                    pairs.append((i, j))
            if total > DENSE * (hi - lo):
                i, j = np.flatnonzero(upper >= 0), np.flatnonzero(lower >= 0)
                pairs = [(i, upper[i]), (j, lower[j])]
                # the members' shard is told by their common key: one number for the bucket's key and its least line
                near = np.flatnonzero((upper >= 0) | (lower >= 0))
                name = textbuf.mix(own[near[:1]].view(np.uint64) + textbuf.mix(shard[lo : lo + 1].astype(np.uint64))).view(np.int64)
                yield _rows(own[near], None, np.repeat(name, len(near)))
            for i, j in pairs:
                if len(i):
                    yield _rows(*_ordered(own[i], own[j]))


def within(n: int) -> int:
    """Most edits between lines of at most n words."""
    return n - int(np.ceil(n * SIMILARITY - 1e-9))


def edits(a: str, b: str) -> int:
    """Levenshtein distance, by Myers' bit vectors."""
    mask: dict[str, int] = {}
    for k, x in enumerate(a):
        mask[x] = mask.get(x, 0) | 1 << k
    full, top, plus, minus, n = (1 << len(a)) - 1, 1 << max(len(a) - 1, 0), (1 << len(a)) - 1, 0, len(a)
    if not a:
        return len(b)
    for x in b:
        eq = mask.get(x, 0)
        d = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        up, down = minus | (full & ~(d | plus)), plus & d
        n += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(d | up)), up & d
    return n


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the verified links in one shard between groups that no link connects yet."""
    for shard, h, group, code in _whole_shards(batches):
        cuts = np.flatnonzero(np.diff(shard)) + 1
        for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(shard)]]), strict=True):
            _, own = np.unique(group[lo:hi], return_inverse=True)
            many = np.fromiter(map(len, code[lo:hi]), np.int64, hi - lo)
            letters, word = np.unique(np.frombuffer("".join(code[lo:hi]).encode("utf-32-le"), np.uint32), return_inverse=True)
            # the members' words and how often they have them
            held, often = np.unique(np.repeat(np.arange(hi - lo), many) * len(letters) + word, return_counts=True)
            begin = np.searchsorted(held, np.arange(hi - lo + 1) * len(letters))
            word = held % len(letters)
            asked = np.zeros(len(letters), np.int64)
            large = np.bincount(own).argmax()
            # members of the largest group need no turn of their own: every link between groups has another end
            for k in np.flatnonzero(own != large).tolist():
                mine = slice(begin[k], begin[k + 1])
                asked[word[mine]] = often[mine]
                shared = np.add.reduceat(np.minimum(asked[word], often), begin[:-1])
                asked[word[mine]] = 0
                # as many words are shared as edits keep, or more
                rest = np.flatnonzero((own != own[k]) & (shared >= np.maximum(many, many[k]) * SIMILARITY - 1e-9))
                for at in rest[np.argsort(-shared[rest], kind="stable")].tolist():
                    if own[at] != own[k]:
                        one, two = code[lo + at], code[lo + k]
                        if edits(*_inner(one, two)) <= within(max(len(one), len(two))):
                            own[own == own[at]] = own[k]
                            yield _rows(*_ordered(h[lo + at : lo + at + 1], h[lo + k : lo + k + 1]))
                if (own == own[k]).all():
                    break


def _inner(a: str, b: str) -> tuple[str, str]:
    """a and b without what both begin or end with."""
    first = len(os.path.commonprefix([a, b]))
    a, b = a[first:], b[first:]
    last = len(os.path.commonprefix([a[::-1], b[::-1]]))
    return a[: len(a) - last], b[: len(b) - last]


def _dealt(rows: DataFrame, *names: str) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "shard").sortWithinPartitions("shard").select("shard", *names)


def _texts(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """(h, line) for the nodes of the edges, a letter for each word, by a scan of docs through a bitmap of their hashes."""
    nodes = edges.select(F.explode(F.array("u", "v")).alias("h"))
    size = min(MAP_BITS, max(1 << 16, 1 << (32 * edges.count()).bit_length()))
    bit, one = F.pmod("h", F.lit(size)), F.expr("shiftleft(1L, cast(bit % 64 as int))")
    words = nodes.withColumn("bit", bit).groupBy(F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()  # at most MAP_BITS / 64 rows
    bitmap = np.zeros(size // 64, np.int64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.view(np.uint8).copy())

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            for _, _, x in _parts(batch):
                bit = x["h"] % size
                hit = np.flatnonzero((x["words"] >= LEAST_WORDS) & (held[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 > 0))
                _, at = np.unique(x["h"][hit], return_index=True)
                hit = hit[at]
                code = (x["hashes"] % np.uint64(LETTERS)).astype(np.uint32) + np.uint32(FIRST_LETTER)
                text = [code[a:b].tobytes().decode("utf-32-le") for a, b in zip(x["first"][hit], x["last"][hit], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x["h"][hit]), pa.array(text, pa.string())], ["h", "line"])

    return docs.select("doc_id", "text").mapInArrow(pick, "h long, line string").groupBy("h").agg(F.min("line").alias("line"))


def _verified(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """The edges whose lines have the edit similarity asked for."""
    left, right = (texts.select(F.col("h").alias(k), F.col("line").alias(f"{k}_line")) for k in "uv")
    both = edges.join(left, "u").join(right, "v")
    most = F.greatest(F.length("u_line"), F.length("v_line"))
    both = both.withColumn("within", most - F.ceil(most * SIMILARITY - 1e-9).cast("int"))
    cheap = F.abs(F.length("u_line") - F.length("v_line")) <= F.col("within")
    return both.filter(cheap & F.expr("levenshtein(u_line, v_line, within) >= 0")).select("u", "v")


def _verified_by_lots(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """_verified, at most some LOT pairs for each of the texts at a time; edges and texts are tables."""
    lots = 1 + edges.count() // (LOT * texts.count() + 1)
    lot = F.pmod(F.xxhash64("u", "v"), F.lit(lots))
    found = []
    for k in range(lots):
        found.append(cut(_verified(edges.filter(lot == k) if lots > 1 else edges, texts), "line-links"))
        _freed(edges.sparkSession)
    return reduce(DataFrame.unionByName, found)


def _freed(spark) -> None:
    """Have Spark delete the shuffle files of steps that have ended: it does so when their plans are collected, which a driver with little garbage does late."""
    spark.sparkContext._jvm.System.gc()


def _links(named: DataFrame, counts: DataFrame) -> DataFrame:
    """(u, v): links of similar lines that connect all that are connected."""
    spark = named.sparkSession
    totals = _totals(counts)
    ranks = spark.sparkContext.broadcast(_ranked(totals))
    some = hot_keys(_sampled_keys(named.filter(F.pmod(F.xxhash64("doc_id"), F.lit(HOT_SAMPLE)) == 1), ranks), HOT_SAMPLE)
    hot = some.orderBy(F.desc("parts"), "key").limit(MOST_HOT).toArrow().sort_by("key")  # a hot key that is not cut is compared in one task
    drop_cut(some)
    hot = spark.sparkContext.broadcast((hot["key"].to_numpy(), hot["parts"].to_numpy().astype(np.int64)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    _freed(spark)
    labels = _labels(spark, parts, 1 + int(totals.sum() * (1 - SIMILARITY)) // (parts * HELD * PASSES))
    tables = []
    for turn in range(PASSES):
        met = _packed(named, ranks, hot, labels, turn, PASSES).repartition(parts, "bucket").sortWithinPartitions("bucket")
        tables.append(cut(met.mapInArrow(_candidates, PAIRS), "line-candidates"))
        del met
        _freed(spark)
    found = reduce(DataFrame.unionByName, tables)
    edges = cut(found.filter("v is not null").select("u", "v").distinct(), "line-edges")
    _freed(spark)
    texts = cut(_texts(named, edges), "line-texts")
    _freed(spark)
    # one edge of each line tells most of what is connected; of the others only those between groups are left to verify
    links = cut(_verified(edges.groupBy("u").agg(F.min("v").alias("v")), texts), "line-links")
    _freed(spark)
    stars = contracted(links, 2)
    group = stars.groupBy(F.col("u").alias("h")).agg(F.min("v").alias("g"))
    both = edges
    for k in "uv":
        both = both.join(group.select(F.col("h").alias(k), F.col("g").alias(f"g{k}")), k, "left")
    rest = cut(both.filter("coalesce(gu, u) != coalesce(gv, v)").select("u", "v"), "line-edges")
    drop_cut(edges)
    drop_cut(stars)
    links = links.unionByName(_verified_by_lots(rest, texts))
    drop_cut(rest)
    large = found.filter("v is null").select("shard", F.col("u").alias("h"))
    if large.limit(1).count():
        # some rounds tell most of what is connected; what they miss is only verified once more
        links = contracted(links, 2)
        group = links.groupBy(F.col("u").alias("h")).agg(F.min("v").alias("g"))
        large = cut(large.join(group, "h", "left").withColumn("g", F.coalesce("g", "h")), "line-members")
        # of shards with the same members (by count and 128 bits) one is enough
        same = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("h")).alias("x"), F.bit_xor(F.xxhash64("h", F.lit(1))).alias("y")]
        open_ = large.groupBy("shard").agg(F.min("g").alias("a"), F.max("g").alias("b"), *same).filter("a < b")
        open_ = open_.groupBy("n", "x", "y").agg(F.min("shard").alias("shard")).select("shard")
        # a member without a candidate has no text here and no near pair in any shard
        rest = large.join(open_, "shard", "left_semi").join(texts, "h")
        new = cut(_dealt(rest, "h", "g", "line").mapInArrow(_across, PAIRS).select("u", "v"), "line-links")
        drop_cut(large)
        links = links.unionByName(new)
    for table in (*tables, texts):
        drop_cut(table)
    return links


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """doc_id, th (xxhash64 of the text), lines: the numbers of the lines to remove, for texts that lose any; copies: rows of that id and text, for all that have several."""
    prepare(docs.sparkSession)
    named = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")
    both = cut(named.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(_occurrences, "doc_id long, th long, line int, h long"), "lines")
    seen = both.filter("doc_id is not null")
    nodes = cut(seen.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "line", "th")).alias("first")), "line-nodes")
    links = _links(named, both.filter("doc_id is null"))
    stars = components(links)
    tops = stars.select(F.col("u").alias("h"), F.col("v").alias("top")).unionByName(stars.select(F.col("v").alias("h"), F.col("v").alias("top")).distinct())
    tops = cut(nodes.join(tops, "h", "left").filter("n > 1 or top is not null").select("h", "top", "first"), "line-tops")
    # lines without a similar one keep their own first occurrence; the others meet their group's in SALTS parts, as a group may be large
    linked = tops.filter("top is not null").withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int"))
    kept = linked.groupBy("top").agg(F.min("first").alias("kept")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    gone = linked.join(kept, ["top", "salt"]).select("h", "kept").unionByName(tops.filter("top is null").select("h", F.col("first").alias("kept")))
    gone = cut(gone, "line-kept")
    same = lambda k: F.col(k) == F.col(f"kept.{k}")
    of = seen.select("doc_id", "th", "line", "h").join(gone, "h").filter(~(same("doc_id") & same("line") & same("th")))
    lines = of.groupBy("doc_id", "th").agg(F.collect_set("line").alias("lines"))
    out = cut(lines, "line-drops")
    for table in (both, nodes, tops, gone, stars):
        drop_cut(table)
    return out


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the text that stays, and n_lines and n_removed.

    Of rows that are equal in doc_id and text one keeps its first occurrences, the others lose every line that has a word.
    """
    names = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    gone = duplicate_lines(docs)
    row = docs.select("doc_id", "text", F.xxhash64("text").alias("th"), F.struct(*names).alias("row"))
    out = row.join(gone, ["doc_id", "th"], "left")
    # rows of one id and text stand beside each other after the join; those without an id take no part
    copy = F.row_number().over(Window.partitionBy("doc_id", "th").orderBy(F.lit(1)))
    out = out.withColumn("again", F.col("doc_id").isNotNull() & (copy > 1))

    def left(parts: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(parts) - 1)
        filled = F.filter(every, lambda i: F.translate(F.get(parts, i), " \t\x0b\x0c\r", "") != "")
        drop = F.when(F.col("again"), filled).otherwise(F.col("lines"))
        stay = F.transform(F.array_except(every, drop), lambda i: F.get(parts, i))
        text = F.when(drop.isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))
        return F.struct(text.alias("text"), F.size(parts).cast("long").alias("n_lines"), F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_removed"))

    # a lambda over an array of one, so that the text is split once
    out = out.withColumn("new", F.get(F.transform(F.array(F.split("text", "\n")), left), 0))
    cells = [F.col("new.text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*cells, *(F.coalesce(F.col("new").getField(c), F.lit(0).cast("long")).alias(c) for c in ("n_lines", "n_removed")))


def query(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document with its first occurrences of lines only."""
    rest = F.struct(*(c for c in docs.columns if c != "text")).alias("rest")  # so that columns with the names of results keep their values
    out = dedup_lines(docs.select("doc_id", "text", rest))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*(new[c].alias(c) if c in new else F.col("rest").getField(c).alias(c) for c in docs.columns))
