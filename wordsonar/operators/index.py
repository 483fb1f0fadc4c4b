"""The inverted index: postings (term, id), one row for each distinct pair, and what is derived from them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import phonetic
from ..functions.text import words

#: Postings that an engine keeps in memory between its searches, at most.
HELD = 1 << 20

#: Makes the sound keys of a word: a column function, or a plain one from a string to a string or a list of strings.
Encoder = Callable


def tokens(records: DataFrame, id_col="id", text_col="text", delimiters: str | None = None, keep_numbers: bool = False) -> DataFrame:
    """(term, id) as the records have them: no shuffle, so pairs may repeat."""
    found = records.select(F.col(id_col).alias("id"), F.explode(words(F.col(text_col), delimiters, keep_numbers)).alias("term"))
    return found.select("term", "id")


def postings(records: DataFrame, id_col="id", text_col="text", delimiters: str | None = None, keep_numbers: bool = False) -> DataFrame:
    """(term, id): pairs repeat neither within a task nor after the one shuffle."""
    return tokens(records, id_col, text_col, delimiters, keep_numbers).distinct()


def key_column(encoder: Encoder | None) -> Callable[[Column], Column]:
    """A column function to array<string> of clean keys; None: the approximate sound key."""
    if encoder is None:
        return phonetic.keys

    @F.pandas_udf("array<string>")
    def udf(terms: pd.Series) -> pd.Series:
        made = {t: key_list(encoder, t) for t in terms.unique()}
        return terms.map(made)

    return lambda c: phonetic.cleaned(udf(c))


def key_list(encoder: Encoder | None, word: str) -> list[str]:
    """A word's keys, on the driver or in a task: no blank and no repeated ones."""
    if encoder is None:
        return phonetic.keys_str(word)
    made = encoder(word)
    made = [made] if isinstance(made, str) else list(made or [])
    return list(dict.fromkeys(k for k in made if k and k.strip()))


def phonetic_postings(terms: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """(term, id) with sound keys in place of the words of (term, id), whose pairs may repeat. Words are encoded where they
    are (Python has each distinct one of a batch once), so only pairs of key and id are shuffled, once."""
    if encoder is None:  # words without a key go first
        terms = terms.where(phonetic.language(F.col("term")) != phonetic.UNKNOWN)
    return terms.select(F.explode(key_column(encoder)(F.col("term"))).alias("term"), "id").distinct()


def coded(terms: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """(term, n, seen, key): the distinct words of (term, id) and each one's sound keys, each word encoded once. n counts a
    word's rows; seen depends on all of its ids, so that errors of the ids come with those of the words."""
    terms = terms.groupBy("term").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("seen"))
    return terms.select("term", "n", "seen", F.explode(key_column(encoder)(F.col("term"))).alias("key"))


def vocabulary(posts: DataFrame) -> DataFrame:
    """(term, len): the distinct terms."""
    return posts.select("term").distinct().select("term", F.length("term").alias("len"))


def deletions(vocab: DataFrame) -> DataFrame:
    """(variant, key): each term itself and with any one character left out."""
    n = F.length("term")
    out = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(F.col("term"), F.lit(1), i - 1), F.substring(F.col("term"), i + 1, n)))
    variants = F.array_distinct(F.concat(F.array("term"), out))
    return vocab.where(n > 0).select(F.explode(variants).alias("variant"), F.col("term").alias("key"))


def deletion_key(value: str, i: int) -> str:
    return "" if len(value) <= 1 else value[:i] + value[i + 1 :]


def lists(posts: DataFrame) -> DataFrame:
    """(term, ids): compact posting lists, ids ascending, for presentation; a frequent term's list is one value."""
    return posts.groupBy("term").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def term_stats(posts: DataFrame) -> DataFrame:
    """(term, n_ids)."""
    return posts.groupBy("term").agg(F.count("*").alias("n_ids"))


@dataclass
class Index:
    """An index as tables. Saved ones are laid out by term, so a search for word beginnings reads few row groups.

    Searches scan rows and shuffle what they find, so a large table's postings are not made for a search. rows are the
    postings unless given: (term, id) whose pairs may repeat, and in sound search words, with coded having their keys.
    """

    posts: DataFrame
    phonetic: bool = False
    rows: DataFrame | None = None
    coded: DataFrame | None = None
    empty: bool | None = None

    def __post_init__(self):
        self.rows = self.posts if self.rows is None else self.rows
        self.vocab = vocabulary(self.rows if self.coded is None else self.coded.select(F.col("key").alias("term")))
        self.deletions = deletions(self.vocab) if self.phonetic else None
        self._hits: DataFrame | None = None

    @staticmethod
    def build(rows: DataFrame, phonetic: bool = False, encoder: Encoder | None = None) -> Index:
        """The index of (term, id), after one pass over all of it, in which errors of the data come. Postings of up to HELD
        rows are kept in memory for the searches to come; of more only the vocabulary is."""
        if phonetic:
            codes = coded(rows, encoder).cache()
            n = codes.agg(F.sum("n")).first()[0] or 0
            index = Index(phonetic_postings(rows, encoder), True, rows, codes, n == 0)
        else:
            n = rows.agg(F.count("*"), F.bit_xor(F.xxhash64("term", "id"))).first()[0]
            index = Index(rows.distinct(), False, rows, None, n == 0)
            index.vocab.cache()
        return index.cache() if n <= HELD else index

    def is_empty(self) -> bool:
        return self.posts.isEmpty() if self.empty is None else self.empty

    def hold(self, hits: DataFrame) -> DataFrame:
        """Keeps the words that a search has found, which it reads twice, until the next search or unpersist."""
        if self._hits is not None:
            self._hits.unpersist()
        self._hits = hits.cache()
        return self._hits

    def cache(self) -> Index:
        """Keeps the postings and what is derived from them, for many searches."""
        if self.rows is not self.posts:
            self.unpersist()
            self.rows = self.coded = None
            self.__post_init__()
        for df in (self.posts, self.vocab, self.deletions):
            if df is not None:
                df.cache()
        return self

    def unpersist(self) -> None:
        for df in (self.posts, self.vocab, self.deletions, self.coded, self._hits):
            if df is not None:
                df.unpersist()

    def save(self, path: str) -> None:
        """Postings, vocabulary and deletions as Parquet, each by ranges of its key and sorted within."""
        for name, key, df in (("postings", "term", self.posts), ("vocabulary", "term", self.vocab), ("deletions", "variant", self.deletions)):
            if df is not None:
                df.repartitionByRange(key).sortWithinPartitions(*df.columns).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str, phonetic: bool = False) -> Index:
        index = Index(spark.read.parquet(f"{path}/postings"), False)
        index.vocab, index.phonetic = spark.read.parquet(f"{path}/vocabulary"), phonetic
        index.deletions = spark.read.parquet(f"{path}/deletions") if phonetic else None
        return index
