"""SimHash near-duplicates linked through BK-trees.

A fingerprint has the majority bits of the XXH64 hashes of a text's word 4-grams. Two fingerprints within RADIUS
differing bits agree in at least `agree` of `blocks` bit blocks, so each fingerprint goes to one shard for every
choice of `agree` blocks; each shard is searched with a BK-tree (children keyed by their integer Hamming distance to
the parent; only edges within the radius of a query's distance are followed). A shard sends a spanning forest of its
links, never the pairs. Shards above HOT members are cut into parts and every pair of parts is searched as a shard
of its own, so that none is unbounded and no link is lost.

Defined cases: a null text has no words; a text without words has fingerprint zero and links like any other. Repeated
rows keep their rows. Null doc_ids stay in the result but name no component unless a group has no other. Other
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerview.llm import textbuf
from ledgerview.llm.common import cut, prepare
from ledgerview.llm.components import components

SHINGLE, SEED, RADIUS = 4, 42, 4
HOT, PART, LEAF, SAMPLE, MOST_HOT = 4096, 2048, 16, 64, 100_000


def fingerprints(column: pa.Array) -> np.ndarray:
    """Fingerprints (uint64) of a string array."""
    data, offsets = textbuf.squeezed(*textbuf.raw(column))
    data = textbuf.lower_ascii(data)
    starts, ends, first = textbuf.bounds(data, offsets)
    words = np.diff(first)
    count = np.where(words >= SHINGLE, words - SHINGLE + 1, np.minimum(words, 1))
    doc = np.repeat(np.arange(len(words)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[:-1][doc]
    last = np.minimum(at + SHINGLE, first[1:][doc]) - 1
    text, digest = data.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(text[a:b], SEED) for a, b in zip(starts[at].tolist(), ends[last].tolist(), strict=True)), np.uint64, len(at))
    return textbuf.majority(h, np.concatenate([[0], np.cumsum(count)]))


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = textbuf.strings(batch.column(1))
        for lo, hi in textbuf.slices(text):
            fp = fingerprints(text.slice(lo, hi - lo)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(fp)], ["doc_id", "fp"])


def _build(values: np.ndarray, members: np.ndarray):
    """A BK-tree: (root, rest without children, [(distance, child)]); small groups stay a leaf."""
    root, rest = members[0], members[1:]
    if len(rest) < LEAF:
        return root, rest, []
    far = np.bitwise_count(values[rest] ^ values[root])
    return root, rest[:0], [(int(d), _build(values, rest[far == d])) for d in np.unique(far)]


def _search(values: np.ndarray, tree, asked: np.ndarray, near, radius: int) -> None:
    """Tell near(root, those within the radius) along all edges that the radius allows."""
    stack = [(tree, asked)]
    while stack:
        (root, rest, children), asked = stack.pop()
        far = np.bitwise_count(values[asked] ^ values[root])
        near(root, asked[far <= radius])
        for one in rest:
            near(one, asked[np.bitwise_count(values[asked] ^ values[one]) <= radius])
        for d, child in children:
            go = asked[np.abs(far.astype(np.int64) - d) <= radius]
            if len(go):
                stack.append((child, go))


def forest(values: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each value of one shard the least value of its group, by a BK-tree search of the shard in itself."""
    parent = np.arange(len(values))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def near(root: int, hits: np.ndarray) -> None:
        tops = {find(int(x)) for x in np.unique(parent[hits])} | {find(int(root))}
        if len(tops) > 1:
            least = min(tops)
            parent[list(tops)] = least

    _search(values, _build(values, np.arange(len(values))), np.arange(len(values)), near, radius)
    return values[[find(x) for x in range(len(values))]]


def _small(key: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links in shards of up to LEAF members, all shards at a time."""
    for d in range(1, LEAF):
        a, b = fp[:-d], fp[d:]
        if not len(a):
            return
        hit = (key[:-d] == key[d:]) & (np.bitwise_count(a ^ b) <= RADIUS)
        yield a[hit], b[hit]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard; the last shard of a batch waits for the next batch."""
    key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def out(a, b):
        lo, hi = np.minimum(a, b).view(np.int64), np.maximum(a, b).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(lo, hi)), pa.array(np.minimum(lo, hi))], ["u", "v"])

    def solve(key, fp):
        cuts = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
        size = np.repeat(ends - starts, ends - starts)
        few = size <= LEAF
        for a, b in _small(key[few], fp[few]):
            if len(a):
                yield out(a, b)
        for lo, hi in zip(starts, ends, strict=True):
            if hi - lo > LEAF:
                values = np.unique(fp[lo:hi])
                top = forest(values)
                if (top != values).any():
                    yield out(values[top != values], top[top != values])

    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
        fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        done = int(np.searchsorted(key, key[-1])) if len(key) and (np.diff(key) >= 0).all() else 0
        if done:
            yield from solve(key[:done], fp[:done])
            key, fp = key[done:], fp[done:]
    if len(key):
        yield from solve(key, fp)


def shards(rows: DataFrame, scheme: tuple[int, int], value: str, ident: str) -> DataFrame:
    """rows with a column `shard`: every 64-bit value in one shard for each choice of agreeing blocks.

    scheme: (blocks, agree); values that differ in at most blocks - agree bits share a shard. ident tells rows apart.
    """
    blocks, agree = scheme
    edge = [round(64 * k / blocks) for k in range(blocks + 1)]
    part = lambda k: F.shiftrightunsigned(value, edge[k]).bitwiseAND(F.lit((1 << (edge[k + 1] - edge[k])) - 1))
    keys = []
    for c, chosen in enumerate(combinations(range(blocks), agree)):
        key = F.lit(c).cast("long")
        for k in chosen:
            key = F.shiftleft(key, edge[k + 1] - edge[k]).bitwiseOR(part(k))
        keys.append(key)
    return split_hot(rows.select("*", F.explode(F.array(*keys)).alias("key")), ident)


def hot_keys(some: DataFrame, share: int) -> DataFrame:
    """key, parts for keys of more than HOT rows, counted on one of `share` rows: a key's size only decides how its rows are dealt, never what is compared."""
    few = some.groupBy("key").count()
    return cut(few.filter(F.col("count") * share > HOT).select("key", F.ceil(F.col("count") * share / PART).cast("int").alias("parts")), "hot-shards")


def split_hot(rows: DataFrame, ident: str, hot: DataFrame | None = None) -> DataFrame:
    """rows with `shard` in place of `key`: keys of many rows are cut, and each pair of parts is a shard."""
    names = [c for c in rows.columns if c != "key"]
    if hot is None:
        hot = hot_keys(rows.filter(F.pmod(F.xxhash64(ident), F.lit(SAMPLE)) == 0), SAMPLE)
    if hot.count() <= MOST_HOT:
        hot = F.broadcast(hot)
    rows = rows.join(hot, "key", "left").withColumn("mine", F.pmod(F.xxhash64(ident), F.col("parts")).cast("int"))
    lower = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.xxhash64("key", F.least(j, "mine"), F.greatest(j, "mine")))
    return rows.select(*names, F.explode(F.when(F.col("parts").isNull(), F.array("key")).otherwise(lower)).alias("shard"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long), component_id for every row of docs(doc_id, text)."""
    spark = prepare(docs.sparkSession)
    marked = cut(docs.select("doc_id", "text").mapInArrow(_fingerprint, "doc_id long, fp long"), "fingerprints")
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    scheme = (6, 2) if distinct.count() < 1 << 26 else (7, 3)
    dealt = shards(distinct.select("fp"), scheme, "fp", "fp").repartition(parts, "shard").sortWithinPartitions("shard").select("shard", "fp")
    stars = components(dealt.mapInArrow(_links, "u long, v long"))
    tops = distinct.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("top")), "fp", "left").withColumn("top", F.coalesce("top", "fp"))
    tops = cut(tops, "tops")
    named = tops.groupBy("top").agg(F.min("least").alias("component_id"))
    grouped = cut(tops.join(named, "top").select("fp", "component_id"), "components")
    return marked.join(grouped, "fp").select("doc_id", "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group the document with the least doc_id stays, and of equal rows one; rows without a
    doc_id stay."""
    names = docs.columns
    first = near_duplicates(docs).filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").withColumn("__h", F.xxhash64("text")).dropDuplicates(["doc_id", "__h"]).drop("__h")
    return kept.unionByName(docs.filter(F.col("doc_id").isNull())).select(*names)
