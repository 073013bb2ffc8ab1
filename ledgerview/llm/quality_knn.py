"""Quality classifier: similarity-weighted votes of the nearest labelled neighbours in a latent semantic space.

Terms of a text are its words, and beside them their shapes (runs of lower case, upper case, digits and marks), pairs of
neighbouring shapes, and repetitions of a word within the last REPEATS words; words carry the content, the others tell
prose from shouting, markup, menus and stutter in any language. Both kinds are hashed, each into its own half of TERMS
buckets, and weighted by TF-IDF; document frequencies are counted over the whole corpus. A text without any word has one
term of its own, so that empty texts are judged by their labels as well.

A bounded sample of labelled documents (at most MOST_LABELLED, in the order of a hash of their id) gives the singular
vectors of the space and the labelled vectors, which are broadcast: at most MOST_LABELLED x RANK numbers. Every whole
document is projected, compared with all of them by exact blocked cosine products, and scored by the labels of its
NEIGHBOURS nearest, weighted by similarity (negative ones count nothing). Of equally near ones the first in doc_id order
count, at a precision of DIGITS digits, so that rounding decides nothing.

Defined cases: a null text is empty. Labels come from rows with a known label only;
several labels of one id count as their rounded mean. Without any labelled document, or with no similar one, a text scores 0.5.
Repeated rows keep their rows. Only doc_id and text of the documents are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerview.llm import textbuf
from ledgerview.llm.common import prepare

TERMS, RANK, REPEATS = 4096, 48, 3
MOST_LABELLED, NEIGHBOURS, BLOCK = 6000, 25, 512
SEED, DIGITS = 5, 4
#: The term of texts without words.
EMPTY = TERMS - 1
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58] = 48
_SHAPE[65:91] = 65
_SHAPE[97:123] = _SHAPE[128:] = 97


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of the terms of all texts."""
    data, offsets = textbuf.raw(column)
    starts, ends, first = textbuf.bounds(data, offsets)
    words = textbuf.span_hashes(data, starts, ends)
    shape = _SHAPE[data]
    upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E))
    shape[upper] = shape[upper + 1] = 65
    new = np.ones(len(shape), bool)
    new[1:] = shape[1:] != shape[:-1]
    new[starts] = True
    at = np.concatenate([[0], np.cumsum(new)])
    shapes = textbuf.span_hashes(shape[new], at[starts], at[ends])
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    terms, owners = [shapes], [doc]
    for back in range(1, REPEATS + 1):
        same = doc[back:] == doc[:-back]
        if back == 1:
            terms.append(textbuf.mix(shapes[1:] * np.uint64(31) + shapes[:-1])[same])
            owners.append(doc[1:][same])
        again = same & (words[back:] == words[:-back])
        terms.append(np.full(int(again.sum()), back, np.uint64))
        owners.append(doc[back:][again])
    half = np.uint64(TERMS // 2)
    shape_cell = np.concatenate(owners) * TERMS + (textbuf.mix(np.concatenate(terms)) % (half - np.uint64(1))).astype(np.int64) + TERMS // 2
    none = np.flatnonzero(np.diff(first) == 0) * TERMS + EMPTY
    cell = np.concatenate([shape_cell, doc * TERMS + (textbuf.mix(words + np.uint64(1)) % half).astype(np.int64), none])
    cell, count = np.unique(cell, return_counts=True)
    return cell // TERMS, cell % TERMS, count


def _vectors(text: np.ndarray, bucket: np.ndarray, count: np.ndarray, idf: np.ndarray, space: np.ndarray | None, rows: int) -> np.ndarray:
    """TF-IDF vectors of unit length, in the latent space if there is one."""
    x = np.sqrt(count).astype(np.float32) * idf[bucket]
    if space is None:
        out = np.zeros((rows, len(idf)), np.float32)
        out[text, bucket] = x
    else:
        out = np.zeros((rows, space.shape[1]), np.float32)
        at = np.flatnonzero(np.diff(text, prepend=-1))
        if len(at):
            out[text[at]] = np.add.reduceat(space[bucket] * x[:, None], at, axis=0)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _slices(batch: pa.RecordBatch):
    text = textbuf.strings(batch.column(1))
    for lo, hi in textbuf.slices(text):
        yield lo, hi, features(text.slice(lo, hi - lo))


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, (_, bucket, _) in _slices(batch):
                df += np.bincount(bucket, minlength=TERMS)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], n))], ["term", "n"])

    df = np.zeros(TERMS + 1, np.int64)
    for term, n in docs.select("doc_id", "text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect():  # TERMS rows at most
        df[term] = n
    return np.log((df[-1] + 1) / (df[:-1] + 1)).astype(np.float32) + 0.1


def sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """At most `most` labelled documents: doc_id, text, label."""
    known = labels.filter("label is not null and doc_id is not null").groupBy("doc_id").agg(F.round(F.avg("label")).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> dict[str, np.ndarray]:
    """idf, space (TERMS x RANK), vectors and labels of the sample, by randomised SVD with two power iterations."""
    idf = inverse_frequencies(docs)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, (text, bucket, count) in _slices(batch):
                ends = np.searchsorted(text, np.arange(hi - lo + 1))
                packed = [[x[a:b].astype(kind).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)] for x, kind in ((bucket, ">u2"), (count, ">u4"))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(x, pa.binary()) for x in packed), batch.column(2).slice(lo, hi - lo)], ["doc_id", "bucket", "count", "label"])

    rows = sample(docs, labels, most).mapInArrow(describe, "doc_id long, bucket binary, count binary, label int").collect()  # bounded by `most`
    if not rows:
        return {"idf": idf, "space": np.zeros((TERMS, 1), np.float32), "vectors": np.zeros((0, 1), np.float32), "labels": np.zeros(0, np.float32)}
    rows.sort(key=lambda r: (r[0], r[3], bytes(r[1])))
    bucket, count = ([np.frombuffer(r[k], kind).astype(np.int64) for r in rows] for k, kind in ((1, ">u2"), (2, ">u4")))

    def blocks(space: np.ndarray | None = None) -> Iterator[np.ndarray]:
        for lo in range(0, len(rows), BLOCK):
            some = bucket[lo : lo + BLOCK]
            text = np.repeat(np.arange(len(some)), [len(x) for x in some])
            yield _vectors(text, np.concatenate(some), np.concatenate(count[lo : lo + BLOCK]), idf, space, len(some))

    q = np.random.default_rng(SEED).standard_normal((TERMS, RANK + 8)).astype(np.float32)
    for _ in range(3):  # the dense rows of a block at a time, never all of them
        q, _ = np.linalg.qr(sum(x.T @ (x @ q) for x in blocks()))
    _, _, vt = np.linalg.svd(np.concatenate([x @ q for x in blocks()]), full_matrices=False)
    space = (q @ vt.T[:, :RANK]).astype(np.float32)
    return {"idf": idf, "space": space, "vectors": np.concatenate(list(blocks(space))), "labels": np.array([r[3] for r in rows], np.float32)}


def votes(z: np.ndarray, vectors: np.ndarray, labels: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Scores of unit vectors z: labels of the nearest vectors weighted by similarity."""
    out = np.full(len(z), 0.5)
    k = min(neighbours, len(labels))
    for lo in range(0, len(z) if k else 0, BLOCK):
        product = z[lo : lo + BLOCK] @ vectors.T
        # similarity first, then place in the sample's order
        rank = np.round(product.astype(np.float64) * 10**DIGITS) * len(labels) - np.arange(len(labels))
        near = np.argpartition(-rank, k - 1, axis=1)[:, :k]
        weight = np.round(np.maximum(np.take_along_axis(product, near, axis=1), 0).astype(np.float64), DIGITS)
        total = weight.sum(axis=1)
        out[lo : lo + BLOCK] = np.where(total > 0, (weight * labels[near]).sum(axis=1) / np.maximum(total, 1e-12), 0.5)
    return np.clip(out, 0, 1)


def score(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """doc_id and score of every document."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            for lo, hi, (text, bucket, count) in _slices(batch):
                z = _vectors(text, bucket, count, held["idf"], held["space"], hi - lo)
                s = votes(z, held["vectors"], held["labels"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(s)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(apply, "doc_id long, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    """The fixed third of the ids from which no label is learnt."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = fit(docs, labels.filter(~held_out()))
    found = score(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
