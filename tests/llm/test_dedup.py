import random

import numpy as np
import pyarrow as pa
import xxhash
from llm_texts import ODD, documents, prose

from ledgerview.llm import line_dedup, simhash_dedup, textbuf
from ledgerview.llm.components import components


def fingerprint(text):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(values, radius=4):
    top = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = top[i], top[j]
                top = [min(a, b) if x in (a, b) else x for x in top]
    return top


def test_near_duplicates_equal_brute_force(spark, odd, none):
    rnd = random.Random(1)
    base = [prose(rnd, 150) for _ in range(8)]
    texts = [*ODD, *base, *base, *(t.replace("alpha", "omega") for t in base), *(t + " end" for t in base)]
    got = {r.doc_id: r for r in simhash_dedup.near_duplicates(documents(spark, texts)).collect()}
    marks = [fingerprint(t) for t in texts]
    assert [got[k].fp % 2**64 for k in range(len(texts))] == marks
    assert [got[k].component_id for k in range(len(texts))] == groups(marks)
    assert simhash_dedup.near_duplicates(none).count() == 0
    kept = simhash_dedup.stage(spark, documents(spark, texts), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups(marks))) and kept.columns == odd.columns


def test_large_shards_are_cut_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "HOT", 8)
    monkeypatch.setattr(simhash_dedup, "PART", 4)
    monkeypatch.setattr(simhash_dedup, "SAMPLE", 1)
    rnd = random.Random(3)
    base = prose(rnd, 60).split()
    texts = []
    for k in range(60):
        words = list(base)
        words[rnd.randrange(len(words))] = f"w{k}"
        texts.append(" ".join(words))
    marks = [fingerprint(t) for t in texts]
    got = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(documents(spark, texts)).collect()}
    assert [got[k] for k in range(60)] == groups(marks)


def test_bk_tree_forest():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 2**63, 300).astype(np.uint64)
    for k in range(200):
        values[k + 100] = values[k] ^ np.uint64(1 << int(rng.integers(64))) ^ np.uint64(1 << int(rng.integers(64)))
    values = np.unique(values)
    got = simhash_dedup.forest(values)
    top = groups([int(v) for v in values])
    same = {}
    for a, b in zip(got.tolist(), top):
        assert same.setdefault(b, a) == a
    assert len(set(got.tolist())) == len(set(top))


def test_components(spark):
    edges = [(k + 1, k) for k in range(50)] + [(100 + k, 100) for k in range(1, 60)] + [(203, 201), (202, 201), (203, 202)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {k: 0 for k in range(1, 51)} | {100 + k: 100 for k in range(1, 60)} | {202: 201, 203: 201}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_lines(spark, odd, none):
    rnd = random.Random(7)
    line = " ".join(rnd.choice("amber birch cedar dune ember frost grove heath inlet jetty knoll ledge marsh".split()) + str(k) for k in range(40))
    near = line.replace("amber", "ambre", 1) if "amber" in line else line + "x"
    texts = [f"first\n{line}\nown words here are kept", f"{near}\nfirst\nsecond", f"  FIRST\n\n{line}\nthird unique words", None, "", "first"]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(documents(spark, texts)).collect()}
    assert got[0].text == texts[0] and got[0].n_removed == 0
    assert "first" not in got[1].text and "second" in got[1].text
    assert got[2].text == "\nthird unique words" and got[2].n_lines == 4 and got[2].n_removed == 2
    assert got[3].text is None and got[4].text == "" and got[5].text == ""
    assert got[0].n_words == 1 and got[0].h == "kept"
    assert got[4].n_lines == 1 and got[3].n_lines == 0
    assert line_dedup.dedup_lines(none).count() == 0 and line_dedup.dedup_lines(odd).count() == len(ODD)


def test_similar_lines_are_linked_also_in_large_shards(spark, monkeypatch):
    words = [f"wording{k}" for k in range(60)]
    variants = [" ".join([*words[:k], f"other{k}x", *words[k + 1 :]]) for k in range(60)]
    removed = {}
    for leaf in (64, 2):
        monkeypatch.setattr(line_dedup, "LEAF", leaf)
        monkeypatch.setattr(line_dedup, "FEW", 1)
        monkeypatch.setattr(line_dedup, "DENSE", 1)
        found = line_dedup.dedup_lines(documents(spark, variants)).collect()
        removed[leaf] = sorted(r.doc_id for r in found if r.n_removed)
    # each variant is two words from every other, so all are similar and the first one stays
    assert removed[64] == removed[2] == list(range(1, 60))


def changed(rnd, words, own):
    """words with as many edits as similarity 0.8 allows, or one more."""
    out = list(words)
    for _ in range(line_dedup.within(len(words)) + rnd.randrange(2)):
        k, kind = rnd.randrange(len(out)), rnd.randrange(3)
        out[k : k + (kind < 2)] = [] if kind == 1 and len(out) > 4 else [rnd.choice(own)]
    return out


def test_similar_lines_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(11)
    own = ["".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(3)) for _ in range(300)]
    lines = []
    for n in (4, 5, 6, 8, 10, 12, 15, 16, 19, 20, 21, 24, 25, 30):
        for _ in range(4):
            base = [rnd.choice(own) for _ in range(n)]
            lines += [base, *(changed(rnd, base, own) for _ in range(3))]
    near = lambda a, b: line_dedup.edits(a, b) <= line_dedup.within(max(len(a), len(b)))
    top = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if near(lines[i], lines[j]):
                top = [min(top[i], top[j]) if t in (top[i], top[j]) else t for t in top]
    want = [k for k in range(len(lines)) if top[k] != k]
    docs = documents(spark, [" ".join(x) for x in lines])
    for leaf in (64, 2):
        monkeypatch.setattr(line_dedup, "LEAF", leaf)
        monkeypatch.setattr(line_dedup, "FEW", 1)
        monkeypatch.setattr(line_dedup, "DENSE", 1)
        assert sorted(r.doc_id for r in line_dedup.dedup_lines(docs).collect() if r.n_removed) == want
    assert len(want) > 100


def test_edits():
    rnd = random.Random(5)

    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(300):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(14))) for _ in range(2))
        assert line_dedup.edits(a, b) == slow(a, b)


def test_word_bounds_and_hashes():
    texts = pa.array(["a bb  c", "", "bb", " \n", "c a"], pa.large_string())
    data, offsets = textbuf.raw(texts)
    starts, ends, first = textbuf.bounds(data, offsets)
    words = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    assert words == [b"a", b"bb", b"c", b"bb", b"c", b"a"] and first.tolist() == [0, 3, 3, 4, 4, 6]
    h = textbuf.span_hashes(data, starts, ends)
    assert h[1] == h[3] and h[2] == h[4] and h[0] == h[5] and len(set(h.tolist())) == 3
    assert list(textbuf.slices(texts, 3)) == [(0, 1), (1, 3), (3, 5)] or sum(b - a for a, b in textbuf.slices(texts, 3)) == 5


def test_rows_of_one_id_lose_only_their_own_repeats(spark):
    one = "first line of the text\nshared words stand here"
    rows = [(1, one), (2, "shared words stand here\nalpha beta"), (2, "a completely unique first line\nshared words stand here"), (2, "shared words stand here\nalpha beta"), (None, one), (None, one), (3, "twice\n\ntwice")]
    got = [(r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = [(1, one, 0), (2, "alpha beta", 1), (2, "a completely unique first line", 1), (2, "", 2), (None, one, 0), (None, one, 0), (3, "twice\n", 1)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_all_pairs_of_three_thousand_lines(spark):
    """Similar pairs by brute force over documents' own kinds of lines: short and long, repeated rows and ids, common words only."""
    rnd = random.Random(5)
    vocab = [f"w{int(rnd.paretovariate(0.25)) % 4000}" for _ in range(6000)]
    lines = []
    while len(lines) < 3000:
        base = [rnd.choice(vocab) for _ in range(rnd.choice((1, 2, 3, 4, 5, 7, 9, 11, 14, 18, 25, 30)))]
        lines += [base, *(changed(rnd, base, vocab) for _ in range(rnd.randrange(3)) if len(base) > 3)]
    lines = lines[:3000]
    group = list(range(3000))

    def top(x):
        while group[x] != x:
            group[x] = x = group[group[x]]
        return x

    count = np.zeros((3000, 4001), np.int16)
    size = np.array([len(x) for x in lines])
    for k, x in enumerate(lines):
        for w in x:
            count[k, int(w[1:])] += 1
    pairs = 0
    for i in range(3000):
        shared = np.minimum(count[: i + 1], count[i]).sum(axis=1)[:i]
        for j in np.flatnonzero(shared >= np.ceil(0.8 * np.maximum(size[:i], size[i]) - 1e-9)).tolist():
            if line_dedup.edits(lines[i], lines[j]) <= line_dedup.within(max(size[i], size[j])):
                pairs += 1
                a, b = top(i), top(j)
                group[max(a, b)] = min(a, b)
    want = [k for k in range(3000) if top(k) != k]
    letters = str.maketrans("0123456789", "abcdefghij")  # digits are all alike to the operator
    docs = documents(spark, [" ".join(x).translate(letters) for x in lines])
    assert sorted(r.doc_id for r in line_dedup.dedup_lines(docs).collect() if r.n_removed) == want
    assert pairs > 500


def test_recall_of_long_lines():
    """Pairs at the limit of similarity share a key in over 98 of 100 cases, whatever their length."""
    rnd = random.Random(2)
    vocab = ["".join(chr(97 + int(c)) for c in str(int(rnd.paretovariate(0.5)))) for _ in range(4000)]
    ranks = np.zeros(1 << 12, np.uint8)
    met = total = 0
    for n in (31, 36, 40, 50, 75, 150, 300):
        for _ in range(60):
            a = [rnd.choice(vocab) for _ in range(n)]
            b = list(a)
            for k in rnd.sample(range(n), line_dedup.within(n)):
                b[k] = rnd.choice(vocab)
            x = line_dedup.lines_of(pa.array([" ".join(a), " ".join(b)], pa.large_string()))
            line, key = line_dedup._keys(x["hashes"], x["words"], ranks)
            met += bool(set(key[line == 0].tolist()) & set(key[line == 1].tolist()))
            total += 1
    assert met / total > 0.98, met / total


def test_a_full_map_of_lines_loses_nothing(spark, monkeypatch):
    assert line_dedup.MAP_BITS <= 1 << 25  # what the driver collects and sends stays some MB at any size
    words = [f"wording{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    docs = documents(spark, [" ".join([*words[:k], f"other{chr(97 + k % 26)}", *words[k + 1 :]]) for k in range(30)])
    want = sorted(map(str, line_dedup.dedup_lines(docs).collect()))
    monkeypatch.setattr(line_dedup, "MAP_BITS", 64)
    assert sorted(map(str, line_dedup.dedup_lines(docs).collect())) == want


def test_words_are_counted_over_all_documents(spark):
    docs = documents(spark, [f"one line of text{'abcdefghijklmnopqrst'[k]}" for k in range(20)])
    rows = docs.selectExpr("doc_id", "xxhash64(text) th", "text").mapInArrow(line_dedup._occurrences, "doc_id long, th long, line int, h long")
    ranks = line_dedup._ranks(rows.filter("doc_id is null"))
    hashes = line_dedup.lines_of(pa.array(["one texta"], pa.large_string()))["hashes"]
    assert ranks[(hashes % np.uint64(line_dedup.RANKS)).astype(int)].tolist() == [int(line_dedup.STEPS * np.log2(21)), line_dedup.STEPS]
    assert rows.filter("doc_id is not null").count() == 20


def long_pairs(rnd):
    """Word lists at the limit of similarity, 31 to 300 words long."""
    vocab = ["".join(chr(97 + int(c)) for c in str(int(rnd.paretovariate(0.5)))) for _ in range(4000)]
    for n in (31, 33, 36, 40, 50, 75, 150, 300):
        for _ in range(250 if n < 100 else 40):
            a = [rnd.choice(vocab) for _ in range(n)]
            b = list(a)
            for k in rnd.sample(range(n), line_dedup.within(n)):
                b[k] = rnd.choice(vocab)
            yield a, b


def test_similar_long_lines_always_share_a_key():
    for ranks in (np.zeros(1 << 12, np.uint8), np.random.default_rng(1).integers(0, 256, 1 << 12).astype(np.uint8)):
        missed = 0
        for a, b in long_pairs(random.Random(2)):
            x = line_dedup.lines_of(pa.array([" ".join(a), " ".join(b)], pa.large_string()))
            line, key = line_dedup._keys(x["hashes"], x["words"], ranks)
            missed += not set(key[line == 0].tolist()) & set(key[line == 1].tolist())
        assert missed == 0


def test_long_lines_whose_rarest_words_differ_share_a_key():
    """Similar lines that differ in all their rarest words: the hardest case of the prefix filter."""
    rnd = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bcdfglmn" for b in "aeiouy" for c in ("ran", "dor", "vex", "lim", "pos", "tul", "gar", "nev", "kit", "sob")]
    hashes = line_dedup.lines_of(pa.array([" ".join(words)], pa.large_string()))["hashes"]
    ranks = np.random.default_rng(3).integers(0, 256, 1 << 12).astype(np.uint8)
    place = {w: (int(ranks[int(h) % len(ranks)]), int(h)) for w, h in zip(words, hashes, strict=True)}
    words.sort(key=place.get)
    missed = 0
    for n in (31, 40, 60, 100):
        for _ in range(50):
            a = rnd.sample(words[100:], n)
            gone = set(sorted(a, key=place.get)[: line_dedup.within(n)])
            new = iter(rnd.sample(words[:100], len(gone)))
            b = [next(new) if w in gone else w for w in a]
            x = line_dedup.lines_of(pa.array([" ".join(a), " ".join(b)], pa.large_string()))
            line, key = line_dedup._keys(x["hashes"], x["words"], ranks)
            missed += not set(key[line == 0].tolist()) & set(key[line == 1].tolist())
    assert missed == 0


def test_keys_travel_packed_and_lose_no_similar_pair(spark, monkeypatch):
    """Every similar pair shares a packed key at places and with parities that no bound rules out, also under hot keys."""
    monkeypatch.setattr(line_dedup, "HELD", 64)
    rnd = random.Random(4)
    own = ["".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(2)) for _ in range(400)]
    lines = []
    for n in (4, 5, 9, 10, 20, 31, 62, 63, 75, 140, 150, 260, 300):
        base = [rnd.choice(own[:40] if n % 2 else own) for _ in range(n)]
        lines += [base, *(changed(rnd, base, own) for _ in range(4))]
        lines.append(base[1:] + base[:1])
    docs = documents(spark, [" ".join(x) for x in lines])
    h = [int(line_dedup.lines_of(pa.array([" ".join(x)], pa.large_string()))["h"][0]) for x in lines]
    want = {tuple(sorted((h[i], h[j]))) for i in range(len(lines)) for j in range(i) if h[i] != h[j] and line_dedup.edits(lines[i], lines[j]) <= line_dedup.within(max(len(lines[i]), len(lines[j])))}
    ranks = spark.sparkContext.broadcast(np.random.default_rng(2).integers(0, 100, 1 << 12).astype(np.uint8))
    labels = line_dedup._labels(spark, 3, 2)
    assert len(set(labels.tolist())) == 6
    sampled = sorted({r.key for r in line_dedup._sampled_keys(docs, ranks).collect()})
    for keys in ([], sampled[::2]):
        hot = spark.sparkContext.broadcast((np.array(keys, np.int64), np.full(len(keys), 3)))
        packed = line_dedup._packed(docs, ranks, hot, labels)
        rows = packed.collect()
        n = sum(len(r.rows) // line_dedup._FORMS[r.form][1].itemsize for r in rows)
        # Spark's own rows of six numbers took 40 bytes a key in shuffle files, for short lines too
        assert n >= len(sampled) and sum(len(r.rows) for r in rows if r.form < 2) <= 30 * n
        for leaf in (64, 2):
            monkeypatch.setattr(line_dedup, "LEAF", leaf)
            monkeypatch.setattr(line_dedup, "DENSE", 1 << 20)
            batches = packed.sortWithinPartitions("bucket").toArrow().sort_by("bucket").to_batches()
            got = {tuple(sorted(p)) for b in line_dedup._candidates(iter(batches)) for p in zip(b["u"].to_pylist(), b["v"].to_pylist(), strict=True)}
            assert len(want) > 60 and want <= got, len(want - got)


def test_word_counts_take_few_rows(spark):
    """Eight counts travel in one row, also counts above an octet: a row for each word before."""
    docs = documents(spark, [" ".join(f"{a}{b}{c}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst" for c in "abcdefghijklmnopqrst" * 13) + " often" * 70000])
    rows = docs.coalesce(1).selectExpr("doc_id", "xxhash64(text) th", "text").mapInArrow(line_dedup._occurrences, "doc_id long, th long, line int, h long").filter("doc_id is null")
    totals = line_dedup._totals(rows)
    at = lambda w: int(line_dedup.lines_of(pa.array([w], pa.large_string()))["hashes"][0] % np.uint64(line_dedup.RANKS))
    assert totals.sum() == 8000 * 13 + 70000 and totals[at("often")] == 70000 + 13 * sum(at(f"{a}{b}{c}") == at("often") for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst" for c in "abcdefghijklmnopqrst")
    assert rows.count() <= 7995


def test_unlike_lines_of_few_words_do_not_become_pairs(spark, monkeypatch):
    # all words are common, and short signatures let the unlike lines pass as near
    rnd = random.Random(29)
    vocabulary = [x + y + z for x in "bdfgklmnpr" for y in "aeiouwy" for z in "bdfgklmnpr"]
    lines = [rnd.choices(vocabulary, k=n) for n in (62, 140, 250) for _ in range(60)]
    lines += [[*x[:-2], "end"] for x in lines[::30]]
    docs = documents(spark, ["\n".join(map(" ".join, lines[k : k + 30])) for k in range(0, len(lines), 30)])
    made, cut = {}, line_dedup.cut
    monkeypatch.setattr(line_dedup, "cut", lambda df, name: made.update({name: cut(df, name)}) or made[name])
    monkeypatch.setattr(line_dedup, "drop_cut", lambda df: None)
    line_dedup.prepare(spark)
    counts = docs.selectExpr("doc_id", "xxhash64(text) th", "text").mapInArrow(line_dedup._occurrences, "doc_id long, th long, line int, h long").filter("doc_id is null")
    monkeypatch.setattr(line_dedup, "_texts", lambda named, edges: 1 / 0)  # the pairs are all that is asked for
    try:
        line_dedup._links(docs.select("doc_id", "text"), counts)
    except ZeroDivisionError:
        pass
    assert 6 <= made["line-edges"].count() < 20


def test_pairs_are_verified_by_lots_without_losing_any(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LOT", 1)
    line_dedup.prepare(spark)
    texts = spark.createDataFrame([(j, "".join(chr(0x10000 + k) for k in range(j, j + 9))) for j in range(12)], "h long, line string")
    edges = spark.createDataFrame([(i, j) for i in range(12) for j in range(i)], "u long, v long")
    got = line_dedup._verified_by_lots(edges, texts)
    assert len(got.inputFiles()) > len(line_dedup.cut(line_dedup._verified(edges, texts), "line-links").inputFiles())
    assert sorted((r.u, r.v) for r in got.collect()) == []  # two edits in nine words
    texts = spark.createDataFrame([(j, "".join(chr(0x10000 + k) for k in range(j, j + 10))) for j in range(12)], "h long, line string")
    assert sorted((r.u, r.v) for r in line_dedup._verified_by_lots(edges, texts).collect()) == [(i, i - 1) for i in range(1, 12)]
