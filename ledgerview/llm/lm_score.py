"""Language-model scores: masked pseudo-likelihood of a bidirectional window network, trained in numpy.

Every word is predicted from the WINDOW words on both sides of it: the context words' vectors for their places are
summed, squashed, and two softmax layers give first the class of the word and then the word in its class. The
conditional log-probabilities of all words of a text sum to its score.

Word counts over all documents give the vocabulary and the first output biases. The most frequent words have entries of
their own in the network; every other word is predicted as the hashed entry it shares and then, by its count in the
corpus, among all words of that entry. So each word has a probability of its own, and the vocabulary, a table that
text is joined with, grows with the corpus; only the network has a fixed size. Words that the counts do not have (in texts
of another corpus) count as one. Texts are written once as word numbers and dealt over shards by a hash of doc_id and text;
the number of shards follows the words of the corpus. Training is data-parallel: from common weights every shard takes
gradient steps on its own texts in a fixed order (every STRIDE-th word of each, in each round at another place, so that ROUNDS
rounds train on every word), and the weights are averaged by the number of words seen, in blocks, so neither a task nor the
driver holds more than one set of weights. Sums are of whole numbers, so scores do not depend on partitions. So what is
counted and learnt grows with the corpus. Every whole text is scored.

Defined cases: a null or empty text has 0 tokens, a sum of 0 and a null mean. A text of one word is predicted from
padding. Repeated rows keep their rows; other columns of the input are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerview.llm import textbuf
from ledgerview.llm.common import cut, drop_cut, prepare

CLASSES, IN_CLASS = 32, 32
VOCABULARY, HASHED = CLASSES * IN_CLASS, 128
PAD, WINDOW, WIDTH = VOCABULARY, 2, 32
STRIDE, ROUNDS, BATCH, RATE, SEED = 2, 2, 1024, 0.1, 3
BLOCKS, LARGEST_LOGIT = 16, 80
#: Words of a shard, the same at every size until there are MOST_SHARDS shards, which then hold more each.
SHARD_WORDS, MOST_SHARDS = 1 << 19, 1 << 16
#: Averages are sums of whole numbers: shares of SHARE_WORDS words, weights in steps of 1 / FINENESS up to LARGEST.
SHARE_WORDS, FINENESS, LARGEST = 1 << 10, 1 << 16, 1 << 7
Weights = dict[str, np.ndarray]


def _hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = textbuf.raw(column)
    data = textbuf.lower_ascii(data)
    starts, ends, first = textbuf.bounds(data, offsets)
    return textbuf.span_hashes(data, starts, ends), first


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    text = textbuf.strings(batch.column(batch.schema.get_field_index("text")))
    for lo, hi in textbuf.slices(text):
        yield lo, hi, *_hashes(text.slice(lo, hi - lo))


def word_counts(docs: DataFrame) -> DataFrame:
    """h, n for every different word."""
    prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, hashes, _ in _slices(batch):
                h, n = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    return cut(docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "word-counts")


def vocabulary(docs: DataFrame, counted: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the most frequent words in order, and the counts of all VOCABULARY entries (the hashed ones last)."""
    named = VOCABULARY - HASHED
    counted = word_counts(docs) if counted is None else counted
    top = counted.orderBy(F.desc("n"), "h").limit(named).collect()
    words = np.array([r[0] for r in top], np.int64).view(np.uint64)
    counts = np.ones(VOCABULARY)
    counts[: len(top)] += [r[1] for r in top]
    return words, counts


def ids_of(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    rest = (VOCABULARY - HASHED + (hashes % np.uint64(HASHED)).astype(np.int64)).astype(np.int64)
    if not len(words):
        return rest
    order = np.argsort(words)
    at = np.searchsorted(words, hashes, sorter=order)
    at[at == len(words)] = 0
    found = order[at]
    return np.where(words[found] == hashes, found, rest)


def contexts(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows of the weight table for each word's neighbours: WINDOW before, WINDOW after."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.full((len(ids), 2 * WINDOW), PAD)
    for k in range(1, WINDOW + 1):
        same = doc[k:] == doc[:-k]
        out[k:, WINDOW - k][same] = ids[:-k][same]
        out[:-k, WINDOW + k - 1][same] = ids[k:][same]
    return out + np.arange(2 * WINDOW) * (VOCABULARY + 1)


def first_weights(counts: np.ndarray) -> Weights:
    rng = np.random.default_rng(SEED)
    share = (counts / counts.sum()).reshape(CLASSES, IN_CLASS)
    shapes = {"context": (2 * WINDOW * (VOCABULARY + 1), WIDTH), "class": (CLASSES, WIDTH), "word": (CLASSES, IN_CLASS, WIDTH)}
    weights = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in shapes.items()}
    weights["hidden"] = np.zeros(WIDTH, np.float32)
    weights["class_bias"] = np.log(share.sum(axis=1)).astype(np.float32)
    weights["word_bias"] = np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)
    return weights


def _exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of bounded logits, in place, and their row sums."""
    np.minimum(z, LARGEST_LOGIT, out=z)
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], z.dtype)


def _hidden(w: Weights, context: np.ndarray) -> np.ndarray:
    h = w["context"].take(context[:, 0], axis=0)
    for k in range(1, context.shape[1]):
        h += w["context"].take(context[:, k], axis=0)
    h += w["hidden"]
    return np.tanh(h, out=h)


def _by_class(cls: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order that puts classes together, and (class, from, to) in this order."""
    order = np.argsort(cls.astype(np.uint8), kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(cls, minlength=CLASSES))]).tolist()
    return order, [(c, ends[c], ends[c + 1]) for c in range(CLASSES) if ends[c] < ends[c + 1]]


def log_probabilities(w: Weights, context: np.ndarray, target: np.ndarray) -> np.ndarray:
    order, runs = _by_class(target // IN_CLASS)
    h, cls, word = _hidden(w, context[order]), (target // IN_CLASS)[order], (target % IN_CLASS)[order]
    every = np.arange(len(target))
    e, total = _exponentials(h @ w["class"].T + w["class_bias"])
    found = e[every, cls] / total
    for c, lo, hi in runs:
        e, total = _exponentials(h[lo:hi] @ w["word"][c].T + w["word_bias"][c])
        found[lo:hi] *= e[every[: hi - lo], word[lo:hi]] / total
    out = np.empty_like(found)
    out[order] = np.log(found)
    return out


def gradient_step(w: Weights, seen: Weights, context: np.ndarray, target: np.ndarray) -> None:
    """One Adagrad step on a batch; seen: sums of squared gradients."""
    order, runs = _by_class(target // IN_CLASS)
    context, cls, word = context[order], (target // IN_CLASS)[order], (target % IN_CLASS)[order]
    h, n = _hidden(w, context), len(target)
    every, ones = np.arange(n), np.ones(n, np.float32)
    p, total = _exponentials(h @ w["class"].T + w["class_bias"])
    p /= total[:, None]
    p[every, cls] -= 1
    grads = {"class": p.T @ h / n, "class_bias": ones @ p / n}
    back = p @ w["class"]
    grads["word"], grads["word_bias"] = np.zeros_like(w["word"]), np.zeros_like(w["word_bias"])
    for c, lo, hi in runs:
        q, total = _exponentials(h[lo:hi] @ w["word"][c].T + w["word_bias"][c])
        q /= total[:, None]
        q[every[: hi - lo], word[lo:hi]] -= 1
        grads["word"][c], grads["word_bias"][c] = q.T @ h[lo:hi], ones[: hi - lo] @ q
        back[lo:hi] += q @ w["word"][c]
    grads["word"] /= n
    grads["word_bias"] /= n
    h *= h
    back *= (1 - h) / n
    grads["hidden"] = ones @ back
    for k, g in grads.items():
        seen[k] += g * g
        w[k] -= RATE * g / np.sqrt(seen[k] + 1e-8)
    flat = context.astype(np.uint16).ravel()  # sorts by radix
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    at = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    rows = flat[at]
    pairs = back.astype(np.float32, copy=False).take(order // context.shape[1], axis=0).view(np.complex64)  # two sums at a time
    g = np.add.reduceat(pairs, at, axis=0).view(np.float32)
    squares = seen["context"].take(rows, axis=0)
    squares += g * g
    seen["context"][rows] = squares
    squares += 1e-8
    g *= RATE
    g /= np.sqrt(squares, out=squares)
    w["context"][rows] -= g


def _flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def _shaped(flat: np.ndarray, like: Weights) -> Weights:
    ends = np.cumsum([like[k].size for k in sorted(like)])
    return {k: x.reshape(like[k].shape).astype(np.float32) for k, x in zip(sorted(like), np.split(flat, ends[:-1]), strict=True)}


def encoded(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """doc_id, sig (a hash of the words), place (of doc_id and sig), ids (two bytes a word) of every text."""
    known = prepare(docs.sparkSession).sparkContext.broadcast(words)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, hashes, first in _slices(batch):
                ids = ids_of(hashes, known.value).astype("<u2")
                rows = pa.array([ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())
                sig = textbuf.sequence_hashes(hashes, first[:-1], first[1:]).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(sig), rows], ["doc_id", "sig", "ids"])

    rows = docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, sig long, ids binary")
    return cut(rows.withColumn("place", F.xxhash64("doc_id", "sig")), "lm-ids")


def averaged(rows: DataFrame, shards: int, weights: Weights, turn: int) -> Weights:
    """Weights after a round over encoded rows: each shard's own steps from `weights`, averaged by the words it saw.

    A shard is read in the order of `place`, and averages are sums of whole numbers, so the result does not depend on tasks.
    """
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    size = len(_flat(weights))
    edges = np.linspace(0, size, BLOCKS + 1).astype(int)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value
        sums, shares = np.zeros(size, np.int64), 0
        current, w, seen, held, waiting, total = None, start, start, [], 0, 0

        def learn() -> int:
            nonlocal held, waiting
            first = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int64)
            ids = np.concatenate([*held, np.zeros(0, np.int64)]).astype(np.int64)
            at = np.flatnonzero((np.arange(len(ids)) - np.repeat(first[:-1], np.diff(first))) % STRIDE == turn % STRIDE)
            if len(at):
                _epoch(w, seen, contexts(ids, first)[at], ids[at])
            held, waiting = [], 0
            return len(at)

        def close() -> None:
            nonlocal sums, shares, total
            total += learn()
            share = -(-total // SHARE_WORDS)
            sums += np.rint(np.clip(_flat(w).astype(np.float64), -LARGEST, LARGEST) * FINENESS).astype(np.int64) * share
            shares += share

        for batch in batches:
            for shard, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shard != current:
                    if current is not None:
                        close()
                    current, total = shard, 0
                    w = {k: v.copy() for k, v in start.items()}
                    seen = {k: np.full_like(v, 1e-2 if k == "context" else 1e-3) for k, v in w.items()}
                held.append(np.frombuffer(raw, "<u2"))
                waiting += len(held[-1])
                if waiting >= 64 * BATCH * STRIDE:
                    total += learn()
        if current is not None:
            close()
        if shares:
            parts = [sums[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int64()), pa.array([shares] * BLOCKS, pa.int64()), pa.array(parts, pa.binary())], ["block", "n", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for block, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                old = sums.get(block, [0, 0])
                sums[block] = [old[0] + n, old[1] + np.frombuffer(raw, np.int64)]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1].tobytes() for v in sums.values()], pa.binary())], ["block", "n", "sums"])

    schema = "block long, n long, sums binary"
    dealt = rows.filter(F.length("ids") > 0).withColumn("shard", F.pmod("place", F.lit(shards)).cast("int"))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "place", "sig").select("shard", "ids")
    found = dealt.mapInArrow(train, schema).repartition(BLOCKS, "block").mapInArrow(add, schema).collect()  # one set of weights
    if not found:
        return weights
    flat = np.zeros(size)
    for block, n, raw in found:
        flat[edges[block] : edges[block + 1]] = np.frombuffer(raw, np.int64) / (n * FINENESS)
    return _shaped(flat, weights)


def _epoch(w: Weights, seen: Weights, context: np.ndarray, target: np.ndarray) -> None:
    order = np.random.default_rng(SEED).permutation(len(target))
    for lo in range(0, len(order), BATCH):
        at = order[lo : lo + BATCH]
        gradient_step(w, seen, context[at], target[at])


def fit(rows: DataFrame, counts: np.ndarray, total: int) -> Weights:
    """Weights learnt from encoded rows of `total` words, the same however the rows are dealt over partitions."""
    weights = first_weights(counts)
    shards = min(MOST_SHARDS, 1 + total // SHARD_WORDS)
    for turn in range(ROUNDS):
        weights = averaged(rows, shards, weights, turn)
    return weights


def total_words(counted: DataFrame) -> int:
    return int(counted.agg(F.sum("n")).first()[0] or 0)


def train(docs: DataFrame, counted: DataFrame | None = None) -> tuple[np.ndarray, Weights]:
    """Words and weights learnt from docs(doc_id, text)."""
    prepare(docs.sparkSession)
    counted = word_counts(docs) if counted is None else counted
    words, counts = vocabulary(docs, counted)
    rows = encoded(docs, words)
    weights = fit(rows, counts, total_words(counted))
    drop_cut(rows)
    return words, weights


def _shared_entries(docs: DataFrame, words: np.ndarray, counted: DataFrame) -> DataFrame:
    """sig, inner: for each text with words that share hashed entries, the mean log-probability of such a word in its entry."""
    known = docs.sparkSession.sparkContext.broadcast(words)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, hashes, first in _slices(batch):
                sig = np.repeat(textbuf.sequence_hashes(hashes, first[:-1], first[1:]), np.diff(first))
                at = np.flatnonzero(ids_of(hashes, known.value) >= VOCABULARY - HASHED)
                at = at[np.lexsort((hashes[at], sig[at]))]
                new = np.ones(len(at), bool)
                new[1:] = (hashes[at[1:]] != hashes[at[:-1]]) | (sig[at[1:]] != sig[at[:-1]])
                k = np.diff(np.append(np.flatnonzero(new), len(at)))
                yield pa.RecordBatch.from_arrays([pa.array(sig[at[new]].view(np.int64)), pa.array(hashes[at[new]].view(np.int64)), pa.array(k.astype(np.int64))], ["sig", "h", "k"])

    frequent = docs.sparkSession.createDataFrame([(int(x),) for x in words.view(np.int64)], "h long")
    others = counted.join(F.broadcast(frequent), "h", "left_anti").withColumn("entry", F.pmod("h", F.lit(HASHED)))
    of = others.groupBy("entry").agg(F.sum("n").alias("of"))  # HASHED rows
    inner = others.join(F.broadcast(of), "entry").select("h", (F.log("n") - F.log("of")).alias("p"), "of")
    least = F.lit(-float(np.log(max(1.0, float(of.agg(F.max("of")).first()[0] or 1)))))
    rows = docs.select("text").mapInArrow(rare, "sig long, h long, k long").join(inner, "h", "left")
    return rows.groupBy("sig").agg((F.sum(F.col("k") * F.coalesce("p", least)) / F.sum("k")).alias("inner"))


def score(docs: DataFrame, words: np.ndarray, weights: Weights, counted: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, mean_log_likelihood for every document; counted: the counts of the corpus of `words`, of docs themselves if not given; rows: docs as `encoded` gives them."""
    spark = prepare(docs.sparkSession)
    counted = word_counts(docs) if counted is None else counted
    rows = encoded(docs, words) if rows is None else rows
    shared = spark.sparkContext.broadcast(weights)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = {k: v.astype(np.float64) for k, v in shared.value.items()}  # with rounding below, equal texts score alike wherever they stand
        for batch in batches:
            raw = batch.column(2).cast(pa.large_binary())
            for lo, hi in textbuf.slices(raw, textbuf.SLICE_BYTES // 4):
                data, offsets = textbuf.raw(raw.slice(lo, hi - lo))
                ids, first = data.view("<u2").astype(np.int64), np.asarray(offsets) // 2
                context = contexts(ids, first)
                logs = np.zeros(len(ids) + 1)
                for a in range(0, len(ids), 4 * BATCH):
                    b = min(a + 4 * BATCH, len(ids))
                    logs[a + 1 : b + 1] = log_probabilities(w, context[a:b], ids[a:b])
                total, n = np.diff(np.cumsum(logs)[first]), np.diff(first)
                rare = np.diff(np.concatenate([[0], np.cumsum(ids >= VOCABULARY - HASHED)])[first])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(np.round(total, 6)), batch.column(1).slice(lo, hi - lo), pa.array(rare.astype(np.int64))], ["doc_id", "n_tokens", "total", "sig", "rare"])

    rows = rows.select("doc_id", "sig", "ids").mapInArrow(apply, "doc_id long, n_tokens long, total double, sig long, rare long")
    rows = rows.join(_shared_entries(docs, words, counted), "sig", "left")
    total = F.col("total") + F.col("rare") * F.coalesce("inner", F.lit(0.0))
    return rows.select("doc_id", "n_tokens", total.alias("log_likelihood"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_likelihood"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = word_counts(docs)
    words, counts = vocabulary(docs, counted)
    rows = encoded(docs, words)
    return score(docs, words, fit(rows, counts, total_words(counted)), counted, rows)
