import random

import numpy as np
import pyarrow as pa
from llm_texts import ODD, documents, prose
from pyspark.sql import functions as F

from ledgerview.llm import decontaminate, lm_score, quality_knn


def test_leaks_and_paraphrases(spark, odd, none):
    rnd = random.Random(1)
    own = [f"{a}{b}" for a in "ba ko mi lu te".split() for b in "ran dor vex lim pos tul gar nev".split()]
    item = lambda: " ".join(rnd.choice(own) + rnd.choice("xyzw") for _ in range(30))
    items = [item() for _ in range(12)]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(90, None), (91, "too short")], "item_id long, text string")
    docs, want = [], set()
    for k in range(60):
        words = prose(rnd, 120).split(" ")
        if k < 12:
            part = items[k].split()
            if k % 3 == 1:
                part = [rnd.choice(own) if rnd.random() < 0.15 else w for w in part]
            if k % 3 == 2:
                part = [w.upper() + "," for w in part]
            words[40:40] = part
            want.add((k, k))
        docs.append(" ".join(words))
    frame = documents(spark, docs)
    found = decontaminate.find(frame, bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want
    kept = decontaminate.without_leaks(frame, bench)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(12, 60)) and kept.columns == frame.columns
    assert decontaminate.find(odd, bench).count() == 0 and decontaminate.find(none, bench).count() == 0
    assert decontaminate.find(frame, bench.limit(0)).count() == 0 and decontaminate.without_leaks(odd, bench).count() == len(ODD)


def test_subsequences():
    def slow(a, b):
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                t[i, j] = t[i - 1, j - 1] + 1 if x == y else max(t[i - 1, j], t[i, j - 1])
        return t[-1, -1]

    rnd = random.Random(3)
    for _ in range(200):
        a, b = ([rnd.randrange(4) for _ in range(rnd.randrange(1, 12))] for _ in range(2))
        mask = {}
        for k, x in enumerate(a):
            mask[x] = mask.get(x, 0) | 1 << k
        assert decontaminate.lcs(mask, len(a), b)[0] == slow(a, b)


def junk(rnd, words):
    return " ".join(rnd.choice("abcdefgh").upper() * 4 + "!!" for _ in range(words)) if rnd.random() < 0.5 else " ".join(rnd.choice("abcdefgh") * 5 + "$$$" for _ in range(words))


def test_quality_votes(spark, odd, none):
    rnd = random.Random(2)
    texts = [prose(rnd, rnd.randrange(20, 200)) if k % 2 else junk(rnd, rnd.randrange(20, 200)) for k in range(400)]
    docs = documents(spark, texts)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    known = labels.filter(~quality_knn.held_out())
    model = quality_knn.fit(docs, known)
    score = {r.doc_id: r.score for r in quality_knn.score(docs, model).collect()}
    asked = [r.doc_id for r in labels.filter(quality_knn.held_out()).collect()]
    assert len(asked) > 80 and all((score[k] >= 0.5) == (k % 2 == 1) for k in asked)
    assert len(quality_knn.fit(docs, known, 50)["labels"]) == 50
    got = {r.doc_id: r.score for r in quality_knn.score(odd, model).collect()}
    assert got[0] == got[1] == got[2] == 0.5 and all(0 <= s <= 1 for s in got.values()) and got[5] == got[6]
    assert quality_knn.score(none, model).count() == 0
    # texts without words are judged by labels as all others are
    more = documents(spark, [*texts, *[""] * 9, *[None] * 9])
    marked = more.select("doc_id", F.when(F.col("doc_id") >= 400, 1).otherwise(F.col("doc_id") % 2).cast("int").alias("label"))
    got = {r.doc_id: r.score for r in quality_knn.score(odd, quality_knn.fit(more, marked)).collect()}
    assert got[0] == got[1] == got[2] > 0.9
    blank = quality_knn.fit(docs, labels.limit(0))
    assert set(r.score for r in quality_knn.score(docs, blank).collect()) == {0.5}


def test_votes_are_exact():
    rng = np.random.default_rng(4)
    z, v = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rng.standard_normal((50, 8)), rng.standard_normal((300, 8))))
    labels = rng.integers(0, 2, 300).astype(float)
    got = quality_knn.votes(z, v, labels, 7)
    for k in range(50):
        s = v @ z[k]
        near = sorted(range(300), key=lambda i: (-round(s[i] * 10**quality_knn.DIGITS), i))[:7]
        w = np.maximum(s[near], 0)
        assert np.isclose(got[k], (w * labels[near]).sum() / w.sum(), atol=1e-3)
    # of equal neighbours the first ones count, in any order of the asked texts
    same = quality_knn.votes(np.repeat(z[:1], 3, axis=0), np.repeat(v[:1], 40, axis=0) * np.sign(v[0] @ z[0]), np.repeat([1.0, 0.0], 20), 25)
    assert np.allclose(same, 0.8)


def test_pseudo_likelihood(spark, odd, none):
    rnd = random.Random(6)
    texts = [prose(rnd, 200) for _ in range(120)]
    strange = [" ".join(f"q{rnd.randrange(10**6)}" for _ in range(60)) for _ in range(5)]
    docs = documents(spark, texts + strange)
    words, weights = lm_score.train(docs)
    got = lm_score.score(docs, words, weights).toPandas().set_index("doc_id").sort_index()
    assert got.n_tokens[:120].eq(200).all() and np.allclose(got.log_likelihood / got.n_tokens, got.mean_log_likelihood)
    counts = lm_score.vocabulary(docs)[1]
    before = lm_score.score(docs, words, lm_score.first_weights(counts)).toPandas().set_index("doc_id").sort_index()
    assert got.mean_log_likelihood[:120].mean() > before.mean_log_likelihood[:120].mean()
    odd_ = {r.doc_id: r for r in lm_score.score(odd, words, weights).collect()}
    assert odd_[0].n_tokens == 0 and odd_[0].log_likelihood == 0 and odd_[0].mean_log_likelihood is None and odd_[4].n_tokens == 1
    assert odd_[5].log_likelihood == odd_[6].log_likelihood
    assert lm_score.train(none)[0].size == 0 and lm_score.score(none, words, weights).count() == 0


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD_WORDS", 4000)
    rnd = random.Random(8)
    docs = documents(spark, [prose(rnd, rnd.randrange(20, 300)) for _ in range(150)] + ["same words here"] * 5)
    runs = []
    for dealt in (docs.repartition(1), docs.repartition(8, "text")):
        words, weights = lm_score.train(dealt)
        runs.append((weights, {r.doc_id: r.log_likelihood for r in lm_score.score(dealt, words, weights).collect()}))
    assert all((runs[0][0][k] == runs[1][0][k]).all() for k in runs[0][0])
    assert runs[0][1].keys() == runs[1][1].keys() and all(np.isclose(runs[0][1][k], runs[1][1][k], atol=1e-5) for k in runs[0][1])


def test_rounds_train_on_every_word():
    assert {k % lm_score.STRIDE for k in range(lm_score.ROUNDS)} == set(range(lm_score.STRIDE))


def test_words_of_a_hashed_entry_share_its_probability(spark):
    docs = documents(spark, [" ".join(f"word{a}x{b}" for b in range(60)) for a in range(40)] + ["word1x1"] * 2)
    counted = lm_score.word_counts(docs)
    known, _ = lm_score.vocabulary(docs, counted)
    inner = lm_score._shared_entries(docs.select("text"), known, counted).toPandas()
    rows = [(r.h % 2**64, r.n) for r in counted.collect()]
    rest = [(h, n) for h, n in rows if h not in {int(x) for x in known}]
    total = {}
    for h, n in rest:
        total[h % lm_score.HASHED] = total.get(h % lm_score.HASHED, 0) + n
    share = [np.log(n / total[h % lm_score.HASHED]) for h, n in rest]
    assert len(rest) == 2400 - lm_score.VOCABULARY + lm_score.HASHED and inner.inner.between(min(share), max(share)).all()


def test_probabilities_sum_to_one():
    w = lm_score.first_weights(np.arange(1, lm_score.VOCABULARY + 1, dtype=float))
    context = np.tile(np.arange(2 * lm_score.WINDOW) * (lm_score.VOCABULARY + 1) + 3, (lm_score.VOCABULARY, 1))
    assert np.isclose(np.exp(lm_score.log_probabilities(w, context, np.arange(lm_score.VOCABULARY))).sum(), 1, atol=1e-3)


def test_gradient_steps_learn():
    w = lm_score.first_weights(np.ones(lm_score.VOCABULARY))
    seen = {k: np.full_like(v, 1e-2) for k, v in w.items()}
    ids = np.tile(np.arange(10), 100)
    context = lm_score.contexts(ids, np.array([0, len(ids)]))
    first = lm_score.log_probabilities(w, context, ids).mean()
    for _ in range(30):
        lm_score.gradient_step(w, seen, context, ids)
    assert lm_score.log_probabilities(w, context, ids).mean() > first + 2


def test_leak_search_holds_few_vectors_at_a_time():
    import tracemalloc

    rnd = random.Random(4)
    items = [" ".join(f"{rnd.choice('bcdfgklm')}{rnd.choice('aeiou')}{k}x" for k in range(30)) for _ in range(30)]
    probes = decontaminate.Probes(list(range(30)), items)
    probes.weigh(np.ones(len(probes.terms), np.int64), 10_000)
    probes.fit(np.zeros(0, np.int64), np.zeros((0, decontaminate.RANK + decontaminate.EXTRA)))
    words = sorted({w for x in items for w in x.split()})
    text = " ".join(rnd.choice(words) for _ in range(100_000)) + " " + items[7]
    hashes, first = decontaminate.words_of(pa.array([text, "nothing of the kind"], pa.large_string()))
    at = np.searchsorted(probes.terms, hashes) % len(probes.terms)
    assert probes.index(hashes).tolist() == np.where(probes.terms[at] == hashes, at, -1).tolist()
    tracemalloc.start()
    found = decontaminate.leaks(hashes, first, probes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (0, 7) in found and all(doc == 0 for doc, _ in found)
    assert peak < 60e6, peak  # two vectors for every word of 4,096 windows took several times that


def test_labelled_texts_are_fitted_in_blocks(spark, monkeypatch):
    rnd = random.Random(12)
    docs = documents(spark, [prose(rnd, 40) if k % 2 else "BUY!! NOW | CLICK | " * 8 + str(k) for k in range(40)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, label int")
    rows = []
    vectors = quality_knn._vectors
    monkeypatch.setattr(quality_knn, "_vectors", lambda *a: rows.append(a[-1]) or vectors(*a))
    whole = quality_knn.fit(docs, labels)
    monkeypatch.setattr(quality_knn, "BLOCK", 7)
    rows.clear()
    parts = quality_knn.fit(docs, labels)
    assert rows and max(rows) <= 7  # the driver holds the dense rows of a block only
    assert np.allclose(parts["vectors"] @ parts["vectors"].T, whole["vectors"] @ whole["vectors"].T, atol=1e-3)
    assert parts["labels"].tolist() == whole["labels"].tolist()
