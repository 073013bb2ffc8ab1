"""Full text as columns: two tokenizers, and a boolean and wildcard query language evaluated left to right."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, MOST = 2, 60
JSON_MARKS = '[]"{}:,'


def column_tokens(text: Column) -> Column:
    """Tokens of a full-text column: lower case, split at single spaces."""
    return F.array_distinct(F.filter(F.split(F.lower(text), " "), lambda x: x != ""))


def document_tokens(text: Column) -> Column:
    """Tokens of a whole document: runs of letters or of digits, of LEAST to MOST characters, with repeats."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{Nd}+|\p{L}+)"), F.lit(0)), lambda x: F.length(x).between(LEAST, MOST))


def body_tokens(body: Column) -> Column:
    """Tokens of a JSON document; names of fields count as words."""
    return document_tokens(F.translate(body, JSON_MARKS, " " * len(JSON_MARKS)))


def _has(tokens: Column, word: str) -> Column:
    if "*" in word or "?" in word:
        pattern = "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in word) + "$"
        return F.exists(tokens, lambda t: t.rlike(pattern))
    return F.array_contains(tokens, word)


def query_column(tokens: Column, query: str, text: Column | None = None) -> Column:
    """Whether tokens match a query: words AND, +word OR, -word AND NOT, in order; * and ? are wildcards.

    text: the lower-cased text, if a cheap test for a plain word may come before the tokens are made.
    """
    out: Column | None = None
    for term in query.lower().split(" "):
        sign, word = (term[0], term[1:]) if term[:1] in ("+", "-") else ("", term)
        if not word:
            continue
        found = _has(tokens, word)
        if text is not None and not re.search(r"[*?]", word):
            found = text.contains(word) & found
        if sign == "-":
            out = ~found if out is None else out & ~found
        elif out is None:
            out = found
        else:
            out = out | found if sign == "+" else out & found
    return F.lit(True) if out is None else out


def matches(column: Column, query: str) -> Column:
    """Full-text match of a column."""
    return query_column(column_tokens(column), query, F.lower(column))


def search_documents(log: DataFrame, query: str, body: str = "body", json: bool = False) -> DataFrame:
    """Versions of the log whose document matches, whatever happened to them later."""
    text = F.col(body)
    return log.filter(query_column(body_tokens(text) if json else document_tokens(text), query, F.lower(text))).select("version")


def word_frequency(df: DataFrame, text: str = "text") -> DataFrame:
    """word and how often it occurs, counted before the shuffle."""
    return df.select(F.explode(document_tokens(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))


def postings(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(word, key) once for each document that has the word."""
    return df.select(F.col(key), F.explode(F.array_distinct(document_tokens(F.col(text)))).alias("word"))


def vocabulary(df: DataFrame, text: str = "text") -> DataFrame:
    return df.select(F.explode(document_tokens(F.col(text))).alias("word")).distinct()


def custom_tokens(text: Column, words_of) -> Column:
    """Tokens of a user's function str -> list of words, in Arrow batches."""
    @F.pandas_udf("array<string>")
    def tokens(column: pd.Series) -> pd.Series:
        return column.map(lambda t: None if t is None else sorted(set(words_of(t))))

    return tokens(text)


def camel_tokens(text: Column) -> Column:
    """document_tokens with words also cut before upper-case letters, for texts that are not lower-cased first."""
    cut = F.regexp_replace(text, r"(?<=\p{Ll})(?=\p{Lu})", " ")
    return document_tokens(cut)


class TextIndex:
    """A standalone index of named documents: postings, and names that were removed."""

    def __init__(self, docs: DataFrame, name: str = "name", text: str = "text"):
        self.name, self.text, self.docs = name, text, docs

    def index(self, more: DataFrame) -> TextIndex:
        """With more documents; those of a known name replace it."""
        kept = self.docs.join(more.select(self.name).distinct(), self.name, "left_anti")
        return TextIndex(kept.unionByName(more.select(*self.docs.columns)), self.name, self.text)

    def remove(self, names: DataFrame) -> TextIndex:
        return TextIndex(self.docs.join(names.select(self.name).distinct(), self.name, "left_anti"), self.name, self.text)

    def is_indexed(self, name) -> bool:
        return not self.docs.filter(F.col(self.name) == name).isEmpty()

    def find_documents(self, query: str) -> DataFrame:
        text = F.col(self.text)
        return self.docs.filter(query_column(document_tokens(text), query, F.lower(text)))

    def find_names(self, query: str) -> DataFrame:
        return self.find_documents(query).select(self.name)

    def postings(self) -> DataFrame:
        return postings(self.docs, self.name, self.text)
