import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_texts import ODD, documents, prose

from ledgerview.llm import packing, token_counts

P = pytest.importorskip("public_tokenizers")


def test_counts_equal_the_library(spark, odd, none):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in token_counts.count_tokens(odd, "piece_bpe_32k.model").collect()}
    for k, t in enumerate(ODD):
        assert got[k].n_tokens == len(model.encode(t or "")) and got[k].n_bytes == len((t or "").encode())
        assert got[k].over_limit == (got[k].n_tokens > 4096)
    assert token_counts.count_tokens(none, "piece_bpe_32k.model").count() == 0


def test_random_strings_and_chunk_bounds():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    machine = token_counts.Transducer(P.path("piece_bpe_32k.model"))
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abcdeth ▁  \n<s>é日1290.,ß😀") for _ in range(rnd.randrange(600))) for _ in range(150)]
    texts += ["".join(rnd.choice(machine.pieces) for _ in range(150)).replace("▁", " ") for _ in range(100)] + ["ab" * 2000, " " * 900, "z" * 257]
    assert machine.counts(pa.array(texts, pa.large_string())).tolist() == [len(x) for x in model.encode(texts)]
    machine.reset()
    assert machine.counts(pa.array(texts[:20], pa.large_string())).tolist() == [len(x) for x in model.encode(texts[:20])]


def test_long_texts_without_spaces(monkeypatch):
    import time

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    machine = token_counts.Transducer(P.path("piece_bpe_32k.model"))
    rnd = random.Random(9)
    texts = ["a" * 5000, "abc" * 3000, "=" * 7001, "".join(rnd.choice("etaoinshrdlu") for _ in range(20000)), "x y " + "-" * 3000 + " z", "0123456789" * 900]
    texts += ["".join(rnd.choice(["ab", "aba", "ing", "tion", "er"]) for _ in range(3000)), "".join(rnd.choice("日本語文字列") for _ in range(3000))]
    want = [len(model.encode(x)) for x in texts]
    assert machine.counts(pa.array(texts, pa.large_string())).tolist() == want
    assert [machine.counts(pa.array([x], pa.large_string()))[0] for x in texts] == want
    with monkeypatch.context() as few:
        few.setattr(token_counts, "MOST_ASKED", 0)  # maps are given up and begun again
        assert machine.counts(pa.array(texts, pa.large_string())).tolist() == want
    text = "".join(rnd.choice("etaoinshrdlu") for _ in range(800_000))
    begin = time.time()
    machine.counts(pa.array([text], pa.large_string()))
    assert time.time() - begin < 15


def test_pieces_cover_documents_and_sequences_have_no_gaps(spark, odd, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rnd = random.Random(4)
    texts = [*ODD, "a<|endoftext|> b", *(prose(rnd, rnd.randrange(5, 1500)) for _ in range(60))]
    found = packing.pack(documents(spark, texts), "byte_bpe_50k.json", "byte_bpe_50k.tiktoken").toPandas()
    for k, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in found[found.doc_id == k].sort_values("start").itertuples():
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for _, g in found.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 1024
    assert found.length.sum() / 1024 / found.sequence_id.nunique() > 0.95
    assert found[found.doc_tokens <= 1024].groupby("doc_id").size().max() == 1
    assert packing.pack(none, "byte_bpe_50k.json", "byte_bpe_50k.tiktoken").count() == 0


def test_documents_that_do_not_combine_are_cut(spark):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["alpha", "beta", "gamma"]) for _ in range(rnd.randrange(560, 700))) for _ in range(40)]
    found = packing.pack(documents(spark, texts), "byte_bpe_50k.json", "byte_bpe_50k.tiktoken").toPandas()
    assert found.doc_tokens.between(513, 1024).all() and found.length.sum() / 1024 / found.sequence_id.nunique() > 0.95
    assert (found.groupby("doc_id").length.sum() == found.groupby("doc_id").doc_tokens.first()).all()


def test_first_basis_is_feasible():
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = np.sort(rng.choice(np.arange(1, 65), rng.integers(1, 40), replace=False))
        need = rng.integers(1, 500, len(lengths)).astype(float)
        basis, x = packing.first_basis(lengths, need, 64)
        assert (x >= 0).all() and np.allclose(basis @ x, need) and (lengths @ basis <= 64).all()
        assert np.linalg.matrix_rank(basis) == len(lengths)


def test_plan_covers_every_histogram():
    rng = np.random.default_rng(1)
    for counts in (np.zeros(65, int), rng.integers(0, 3, 65), rng.integers(0, 9000, 65), np.eye(65, dtype=int)[64] * 5):
        counts = counts.copy()
        counts[0] = 0
        slots, sequences = packing.plan(counts, 64)
        filled = {}
        for length in np.flatnonzero(counts):
            own = slots["length"] == length
            first = slots["first"][own]
            assert first[0] == 0 and (np.diff(first) > 0).all()
            rank = np.arange(counts[length])
            at = np.searchsorted(first, rank, side="right") - 1
            rel, each = rank - first[at], slots["each"][own][at]
            for seq, place in zip(slots["base"][own][at] + rel // each, slots["place"][own][at] + rel % each * length):
                filled.setdefault(int(seq), []).append((int(place), int(length)))
        for parts in filled.values():
            at = 0
            for place, length in sorted(parts):
                assert place == at
                at += length
            assert at <= 64
        assert sorted(filled) == list(range(sequences))


def test_column_generation_reaches_the_bound():
    counts = np.zeros(1025, int)
    counts[[700, 324, 512, 100]] = [1000, 1000, 500, 37]
    total = sum(x for _, x in packing.column_generation(counts, 1024))
    assert total <= 1.01 * ((counts * np.arange(1025)).sum() / 1024) + 4
