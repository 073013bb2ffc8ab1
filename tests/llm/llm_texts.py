"""Texts that the tests of this folder share."""

import random

#: Shapes that every operator must take: nulls, empties, repeats, ties, very long texts, odd characters.
ODD = [None, "", " ", "\n\n", "word", "Same text twice. " * 3, "Same text twice. " * 3, "no punctuation here", "x" * 5000, "é😀 日本語 \x00   end.", "a b c d e f g h " * 400, "LOUD WORDS SHOUTED HERE AGAIN!! " * 9, "one | two | three | four | five"]
VOCAB = ["alpha", "beta", "gamma", "delta", "house", "river", "stone", "green", "quick", "light", "paper", "under", "night", "voice", "table", "water", "cloud", "field", "north", "bread", "glass", "music", "plant", "smile", "train"]


def prose(rnd: random.Random, words: int) -> str:
    out, line = [], []
    for k in range(words):
        line.append(rnd.choice(VOCAB) + rnd.choice(["", "s", "ed", "ing", "ly", "er"]))
        if len(line) == 12 or k == words - 1:
            out.append(" ".join(line).capitalize() + ".")
            line = []
    return "\n".join(out)


def documents(spark, texts, start=0):
    """Texts as documents with a null id and clashing extra columns among them."""
    rows = [(k + start, t, "en", "s", len(t or ""), 1, "kept") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int, h string").repartition(3)
