"""Benchmark decontamination by latent semantic retrieval.

Benchmark items become probes of LEAST_WORDS to PROBE_WORDS words; their terms are the vocabulary. Three scans:
document frequencies of the terms over the passages of all documents; the term-by-term Gram matrix of the TF-IDF
passages, summed as sparse entries, from which a randomised (single-pass, Nystrom) SVD gives the latent space; then
sliding windows of every whole document are projected, compared with all probes by cosine, and candidates verified by
their longest common subsequence of words with the probe, with a check of the probe's closing words (the answer) where
the subsequence alone is not conclusive, as for paraphrases.

Words are compared in lower case without punctuation. The probes and the space are bounded by the benchmark (checked against
MOST_ITEMS), never by the corpus.

Defined cases: a null text is empty; texts shorter than the least share of a probe cannot match. Items of fewer than
LEAST_WORDS words are not searched. Repeated rows give repeated results. An empty benchmark or table gives no rows.
Extra columns are ignored by `find` and kept by `stage`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerview.llm import textbuf
from ledgerview.llm.common import prepare

LEAST_WORDS, PROBE_WORDS, PASSAGE = 5, 96, 48
MOST_ITEMS, MOST_SHARE, LEAST_TERMS, RANK, EXTRA, SEED = 200_000, 0.001, 12, 128, 8, 11
#: Candidates: least cosine; least TF-IDF mass and number of terms of a window, as shares of the least of a probe; least
#: share of the probe's mass in the terms that both have. All are well below what LIKELY needs.
COSINE, MASS, MATCHES, COVER = 0.25, 0.4, 0.4, 0.3
#: Longest common subsequence as a share of the probe: enough by itself, and enough with the closing words.
SURE, LIKELY, ANSWER_WORDS, ANSWER_SHARE = 0.8, 0.55, 5, 0.6
SCALES = (32, 64, 128)
#: Most words of the vocabulary whose vectors are summed at a time, whatever the windows hold: memory stays bounded.
HELD = 1 << 14
_CLEAN = textbuf.lower_ascii(np.arange(256, dtype=np.uint8))
_CLEAN[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 32


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the normalised words of all texts, and each text's first word (one more at the end)."""
    data, offsets = textbuf.raw(column)
    data = _CLEAN[data]
    wide = np.flatnonzero(data[:-1] == 0xC3) + 1
    upper = wide[(data[wide] >= 0x80) & (data[wide] <= 0x9E) & (data[wide] != 0x97)]
    data[upper] += 0x20
    starts, ends, first = textbuf.bounds(data, offsets)
    return textbuf.span_hashes(data, starts, ends), first


class Probes:
    """Probes of the benchmark, their vocabulary, weights and latent vectors."""

    def __init__(self, ids: list, texts: list[str]):
        hashes, first = words_of(pa.array(texts, pa.large_string()))
        self.item, self.words = [], []
        for k, item in enumerate(ids):
            own = hashes[first[k] : first[k + 1]]
            parts = max(1, round(len(own) / PROBE_WORDS + 0.2))
            for part in np.array_split(own, parts):
                if len(part) >= LEAST_WORDS:
                    self.item.append(item)
                    self.words.append(part)
        self.terms = np.unique(np.concatenate([*self.words, np.zeros(0, np.uint64)]))
        self.masks = []
        for own in self.words:
            mask: dict[int, int] = {}
            for k, w in enumerate(own.tolist()):
                mask[w] = mask.get(w, 0) | 1 << k
            self.masks.append(mask)

        # where the terms of each leading part of a hash begin, and how many a part has at most
        bits = min(22, len(self.terms).bit_length() + 6)
        self.shift = np.uint64(64 - bits)
        sizes = np.bincount((self.terms >> self.shift).astype(np.int64), minlength=1 << bits)
        self.begin = (np.cumsum(sizes) - sizes).astype(np.int32)
        self.depth = int(sizes.max())
        self.padded = np.append(self.terms, np.uint64((1 << 64) - 1))

    def index(self, hashes: np.ndarray) -> np.ndarray:
        """Term numbers of words, -1 for words outside the vocabulary."""
        at = self.begin[(hashes >> self.shift).view(np.int64)]
        for _ in range(self.depth):
            at += self.padded[at] < hashes
        return np.where((self.padded[at] == hashes) & (at < len(self.terms)), at, -1).astype(np.int64)

    def weigh(self, df: np.ndarray, passages: int) -> None:
        idf = np.log((passages + 1) / (df + 1)) + 1e-3
        use = df <= max(MOST_SHARE * passages, 1)
        for own in self.words:  # every probe keeps at least its rarest terms
            at = self.index(np.unique(own))
            use[at[np.argsort(df[at], kind="stable")[:LEAST_TERMS]]] = True
        self.weight = np.where(use, idf, 0).astype(np.float32)

    def fit(self, rows: np.ndarray, sketch: np.ndarray) -> None:
        """The latent space from the rows of Gram x test matrix that are not zero; probes count as passages."""
        omega = test_matrix(len(self.terms))
        y = np.zeros_like(omega)
        y[rows] = sketch
        own = np.zeros((len(self.words), len(self.terms)), np.float32)
        for k, w in enumerate(self.words):
            np.add.at(own[k], self.index(w), self.weight[self.index(w)])
        size = np.linalg.norm(own, axis=1, keepdims=True)
        y += own.T @ ((own / np.maximum(size, 1e-9) ** 2) @ omega) * np.median(size**2)
        core = omega.T @ y
        core = (core + core.T) / 2
        value, vector = np.linalg.eigh(core + 1e-6 * np.trace(core) / len(core) * np.eye(len(core)))
        keep = value > 1e-9 * value[-1]
        u, s, _ = np.linalg.svd(y @ (vector[:, keep] / np.sqrt(value[keep])), full_matrices=False)
        self.space = u[:, :RANK][:, s[:RANK] > 1e-6 * s[0]].astype(np.float32)
        self.weighted = self.space * self.weight[:, None]
        latent = own @ self.space
        self.mass = (own**2).sum(axis=1)
        self.own_terms = ((own > 0) & (self.weight > 0)).sum(axis=1)
        self.share = np.where(own > 0, self.weight**2, 0) / np.maximum((np.where(own > 0, self.weight, 0) ** 2).sum(axis=1, keepdims=True), 1e-9)
        self.share = self.share.astype(np.float32)
        self.latent = latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
        length = np.array([len(w) for w in self.words])
        self.scale = np.searchsorted(np.array(SCALES[:-1]) / 1.3, length)


def test_matrix(terms: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((terms, RANK + EXTRA)) / np.sqrt(RANK + EXTRA)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    text = textbuf.strings(batch.column(batch.schema.get_field_index("text")))
    for lo, hi in textbuf.slices(text):
        yield lo, hi, *words_of(text.slice(lo, hi - lo))


def _passages(hashes: np.ndarray, first: np.ndarray, probes: Probes) -> tuple[np.ndarray, np.ndarray, int]:
    """(passage, term) of the words of the vocabulary, and the number of passages."""
    per = -(-np.diff(first) // PASSAGE)
    base = np.cumsum(per) - per
    at = np.arange(len(hashes))
    doc = np.searchsorted(first, at, side="right") - 1
    term = probes.index(hashes)
    hit = np.flatnonzero(term >= 0)
    return base[doc[hit]] + (at[hit] - first[doc[hit]]) // PASSAGE, term[hit], int(per.sum())


def _sums(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, where = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(where, np.concatenate(values), len(k))


def document_frequencies(docs: DataFrame, probes: Probes) -> tuple[np.ndarray, int]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(len(probes.terms), np.int64), 0
        for batch in batches:
            for _, _, hashes, first in _slices(batch):
                passage, term, n = _passages(hashes, first, probes)
                df += np.bincount(np.unique(passage * len(df) + term) % len(df), minlength=len(df))
                total += n
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], total))], ["term", "n"])

    df = np.zeros(len(probes.terms) + 1, np.int64)
    for term, n in docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect():  # a row for each term
        df[term] = n
    return df[:-1], int(df[-1])


def gram_sketch(docs: DataFrame, probes: Probes) -> tuple[np.ndarray, np.ndarray]:
    """Rows of (passages' Gram matrix x test matrix): the Gram matrix is summed as sparse entries, over all documents."""
    terms = len(probes.terms)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = [np.zeros(0, np.int64)], [np.zeros(0)]
        for batch in batches:
            for _, _, hashes, first in _slices(batch):
                passage, term, _ = _passages(hashes, first, probes)
                use = probes.weight[term] > 0
                cell, tf = np.unique(passage[use] * terms + term[use], return_counts=True)
                passage, term = cell // terms, cell % terms
                x = tf * probes.weight[term]
                size = np.bincount(np.searchsorted(np.unique(passage), passage)) if len(cell) else np.zeros(0, np.int64)
                # all pairs within a passage: bounded by PASSAGE terms
                each = np.repeat(size, size)
                a = np.repeat(np.arange(len(cell)), each)
                b = np.arange(len(a)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(np.repeat(np.cumsum(size) - size, size), each)
                keys.append(term[a] * terms + term[b])
                values.append(x[a].astype(float) * x[b])
                if sum(map(len, keys)) > 2_000_000:
                    keys, values = map(lambda z: [z], _sums(keys, values))
        k, v = _sums(keys, values)
        yield pa.RecordBatch.from_arrays([pa.array(k // max(terms, 1)), pa.array(k % max(terms, 1)), pa.array(v)], ["i", "j", "g"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omega = test_matrix(terms)
        rows: dict[int, np.ndarray] = {}
        for batch in batches:
            i, j, g = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            order = np.argsort(i, kind="stable")
            i, j, g = i[order], j[order], g[order]
            for k, at in zip(*np.unique(i, return_index=True), strict=True):
                to = np.searchsorted(i, k, side="right")
                rows[int(k)] = rows.get(int(k), 0) + g[at:to] @ omega[j[at:to]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array([v.tobytes() for v in rows.values()], pa.binary())], ["i", "y"])

    summed = docs.select("text").mapInArrow(entries, "i long, j long, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = summed.repartition(parts, "i").mapInArrow(multiply, "i long, y binary").collect()  # RANK numbers for each term
    y = np.zeros((terms, RANK + EXTRA))
    for i, raw in found:
        y[i] += np.frombuffer(raw)
    rows = np.unique([i for i, _ in found]).astype(np.int64)
    return rows, y[rows]


def lcs(mask: dict[int, int], n: int, words: list[int]) -> tuple[int, int]:
    """Length of the longest common subsequence, and the places of the probe that it leaves out, as bits."""
    full = (1 << n) - 1
    s = full
    for w in words:
        u = s & mask.get(w, 0)
        if u:
            s = ((s + u) | (s - u)) & full
    return n - s.bit_count(), s


def _windows(term: np.ndarray, first: np.ndarray, mass: np.ndarray, probes: Probes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, ends, probes, cosines) of candidate windows, one array element for each candidate."""
    spots = np.flatnonzero((term >= 0) & (mass > 0))
    held, sums = term[spots], np.concatenate([[0], np.cumsum(mass[spots], dtype=np.float64)])
    words = np.diff(first)
    for k, size in enumerate(SCALES):
        mine = np.flatnonzero(probes.scale == k)
        if not len(mine):
            continue
        step = size // 4
        per = np.maximum(1, -(-(words - size) // step) + 1) * (words > 0)
        doc = np.repeat(np.arange(len(words)), per)
        start = first[doc] + step * (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per))
        end = np.minimum(start + size, first[doc + 1])
        a, b = np.searchsorted(spots, start), np.searchsorted(spots, end)
        keep = ((sums[b] - sums[a]) >= MASS * probes.mass[mine].min()) & (b - a >= MATCHES * probes.own_terms[mine].min())
        start, end, a, b = start[keep], end[keep], a[keep], b[keep]
        done = np.cumsum(b - a)
        lo = 0
        while lo < len(start):
            part = slice(lo, max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + HELD, side="right"))))
            lo = part.stop
            n = b[part] - a[part]
            row = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + a[part][row]
            vector = probes.weighted.take(held[at], axis=0)
            z = np.add.reduceat(vector, np.cumsum(n) - n, axis=0)  # no window here is empty: its mass is positive
            z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
            cosine = z @ probes.latent[mine].T
            w, p = np.nonzero(cosine >= COSINE)
            pair = np.repeat(np.arange(len(w)), n[w])
            at = np.arange(len(pair)) - np.repeat(np.cumsum(n[w]) - n[w], n[w]) + a[part][w[pair]]
            cover = np.bincount(pair, probes.share[mine[p[pair]], held[at]], len(w))
            w, p = w[cover >= COVER], p[cover >= COVER]
            yield start[part][w], end[part][w], mine[p], cosine[w, p]


def leaks(hashes: np.ndarray, first: np.ndarray, probes: Probes) -> dict[tuple[int, int], tuple]:
    """{(text, probe): (common words, cosine)} of the verified candidates of one slice."""
    term = probes.index(hashes)
    mass = np.where(term >= 0, probes.weight[term] ** 2, 0)
    found: dict[tuple[int, int], tuple] = {}
    for starts, ends, which, cosines in _windows(term, first, mass, probes):
        docs = np.searchsorted(first, starts, side="right") - 1
        for start, end, doc, p, cosine in zip(starts.tolist(), ends.tolist(), docs.tolist(), which.tolist(), cosines.tolist(), strict=True):
            n = len(probes.words[p])
            if found.get((doc, p), (0,))[0] >= SURE * n:
                continue
            lo, hi = max(int(first[doc]), start - n // 2), min(int(first[doc + 1]), end + n // 2)
            common, missed = lcs(probes.masks[p], n, hashes[lo:hi].tolist())
            tail = min(ANSWER_WORDS, n)
            answer = tail - (missed >> (n - tail)).bit_count()
            if common >= SURE * n or (common >= LIKELY * n and answer >= ANSWER_SHARE * tail):
                found[doc, p] = max(found.get((doc, p), (0, 0.0)), (common, cosine))
    return found


def prepared(docs: DataFrame, benchmark: DataFrame) -> Probes | None:
    """Probes with the latent space of docs; None without any probe."""
    n = benchmark.count()
    if n > MOST_ITEMS:
        raise ValueError(f"{n} benchmark items; search them in parts of at most {MOST_ITEMS}")
    rows = benchmark.filter("text is not null").select("item_id", "text").collect()
    probes = Probes([r[0] for r in rows], [r[1] for r in rows])
    if not probes.words:
        return None
    probes.weigh(*document_frequencies(docs, probes))
    probes.fit(*gram_sketch(docs, probes))
    return probes


FOUND = "doc_id long, item_id long, probe_words long, common_words long, cosine double"


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """FOUND: a row for every document and probe whose passage it holds."""
    spark = prepare(docs.sparkSession)
    probes = prepared(docs, benchmark)
    if probes is None:
        return spark.createDataFrame([], FOUND)
    shared = spark.sparkContext.broadcast(probes)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            for lo, hi, hashes, first in _slices(batch):
                found = leaks(hashes, first, held)
                docs_, p = [d for d, _ in found], [k for _, k in found]
                ids = batch.column(0).slice(lo, hi - lo).cast(pa.int64()).take(pa.array(docs_, pa.int64()))
                items = pa.array([held.item[k] for k in p], pa.int64())
                sizes = pa.array([len(held.words[k]) for k in p], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, items, sizes, pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.float64())], ["doc_id", "item_id", "probe_words", "common_words", "cosine"])

    return docs.select("doc_id", "text").mapInArrow(search, FOUND)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark passage."""
    spark = prepare(docs.sparkSession)
    probes = prepared(docs, benchmark)
    if probes is None:
        return docs
    shared = spark.sparkContext.broadcast(probes)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for lo, _, hashes, first in _slices(batch):
                for doc, _ in leaks(hashes, first, shared.value):
                    clean[lo + doc] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumn("cosine", F.round("cosine", 4))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark passage go."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
