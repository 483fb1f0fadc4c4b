"""Language identification by rank-order profiles.

A language's profile is the list of its `size` most frequent character n-grams (one to three letters, words padded by a
blank). A document's n-grams are ranked by frequency in the same way, and its distance to a profile is the sum over its
most frequent `size` n-grams of how far each is out of place: the difference of the ranks, or `size` where the profile
lacks the n-gram. The nearest profile's language is predicted.

Profiles are learned from about PER_LANGUAGE labelled documents of a language: where there are more, a share drawn by a
hash of id and text. They hold at most `size` n-grams each, so what goes to the executors has a bound. Whole texts are
counted where they are, in numpy, in slices of bounded size (a long text in several); only counts are shuffled.

Defined results: `und` with score 0 for null texts, texts without a letter, and where no language was learned; ties
of frequency go by the n-gram's code, ties of distance to the first language by name; repeated rows give repeated
results; extra columns are not read. Score is 1 - distance / greatest possible distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import extended, held, slices

#: Labelled documents of a language that its profile is learned from, and n-grams in a profile.
PER_LANGUAGE, SIZE = 1000, 400
UNKNOWN = "und"
#: Characters of text in one set of arrays.
SLICE = 1 << 18
_COUNT = 22  # bits of a count when n-grams are ranked; larger counts tie


def _letters() -> np.ndarray:
    """Of each code point: a code below 2 ** 14 if it is a letter, else 0. Codes of rare letters may coincide."""
    table = np.zeros(0x110000, dtype=np.int64)
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()])
    table[points] = points % 16381 + 1
    return table


_table: np.ndarray | None = None


def _grams(low: str) -> tuple[np.ndarray, np.ndarray]:
    """(place, n-gram code) of every n-gram of a lower-cased text; an n-gram's place is that of its middle letter."""
    global _table
    if _table is None:
        _table = _letters()
    c = _table[np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    # pads: 0 stands for whatever is not a letter, so a word's neighbours are its pads
    before, after = np.concatenate(([0], c[:-1])), np.concatenate((c[1:], [0]))
    at = np.flatnonzero(c)
    one, b, a = c[at], before[at], after[at]
    pad = np.flatnonzero(b == 0)
    codes = np.concatenate((one, (one << 14 | a) + (1 << 42), (b << 28 | one << 14 | a) + (2 << 42), (one[pad]) + (1 << 42)))
    return np.concatenate((at, at, at, at[pad])), codes


def _counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with how often each occurs, or the sum of its weights."""
    if weights is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(keys))) if weights is None else np.add.reduceat(weights, first) if len(keys) else weights
    return keys[first], counts


def counts_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """document << 44 | n-gram code of every n-gram of the texts, ascending, and its count. A text beyond SLICE
    characters is counted piece by piece, each with one character more at either end."""
    low = [t.lower() for t in texts]
    short = [k for k, t in enumerate(low) if len(t) <= SLICE]
    place, codes = _grams("\n".join([low[k] for k in short]))
    doc = np.repeat(np.array(short, dtype=np.int64), [len(low[k]) + 1 for k in short])
    keys, counts = _counted(doc[place] << 44 | codes)
    for k, t in enumerate(low):
        if len(t) > SLICE:
            own, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for i in range(0, len(t), SLICE):
                lead = min(i, 1)
                place, codes = _grams(t[i - lead : i + SLICE + 1])
                found, m = _counted(codes[(place >= lead) & (place < lead + SLICE)])
                own, n = _counted(np.concatenate((own, found)), np.concatenate((n, m)))
            keys, counts = np.concatenate((keys, k << 44 | own)), np.concatenate((counts, n))
    order = np.argsort(keys, kind="stable")
    return keys[order], counts[order]


class Ranked:
    """Each document's `size` most frequent n-grams with their ranks from 0."""

    def __init__(self, texts: list[str], size: int):
        keys, counts = counts_of(texts)
        doc = keys >> 44
        by = doc << _COUNT | np.maximum(0, (1 << _COUNT) - 1 - counts)
        place = np.argsort(by, kind="stable")
        doc = doc[place]
        begin = np.searchsorted(doc, np.arange(len(texts)))
        rank = np.arange(len(doc)) - begin[doc]
        top = rank < size
        self.doc, self.rank = doc[top], rank[top]
        self.code, self.count = keys[place][top] & ((1 << 44) - 1), counts[place][top]
        self.many = np.bincount(self.doc, minlength=len(texts))


class Profiles:
    def __init__(self, profiles: dict[str, list[int]], size: int = SIZE):
        self.size, self.names = size, sorted(profiles)
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], dtype=np.int64))
        self.ranks = np.full((len(self.names), len(self.codes) + 1), -1, dtype=np.int64)
        for k, name in enumerate(self.names):
            self.ranks[k, np.searchsorted(self.codes, np.array(profiles[name], dtype=np.int64))] = np.arange(len(profiles[name]))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        r = Ranked(texts, self.size)
        if not self.names or not len(self.codes):
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        at = np.searchsorted(self.codes, r.code)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != r.code] = len(self.codes)
        distance = np.empty((len(self.names), len(texts)))
        for k in range(len(self.names)):
            theirs = self.ranks[k, at]
            out = np.where(theirs < 0, self.size, np.abs(theirs - r.rank))
            distance[k] = np.bincount(r.doc, weights=out, minlength=len(texts))
        best = distance.argmin(axis=0)
        scores = np.clip(1 - distance[best, np.arange(len(texts))] / np.maximum(1, r.many * self.size), 0, 1)
        names = [self.names[b] if n else UNKNOWN for b, n in zip(best, r.many, strict=True)]
        return names, np.where(r.many > 0, scores, 0.0)


def _strings(batch: pa.RecordBatch, column: str) -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def learn(labelled: DataFrame, text_col="text", lang_col="lang", id_col="doc_id", per_language: int = PER_LANGUAGE, size: int = SIZE) -> Profiles:
    """Profiles from (text, language) rows; rows where either is null teach nothing. The id, if there is one, only lets
    a draw tell copies apart."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    many = rows.groupBy(F.col(lang_col).alias("lang")).count().collect()  # a row for each language
    if not many:
        return Profiles({}, size)
    share = F.create_map(*[F.lit(x) for lang, n in many for x in (lang, min(1.0, per_language / n))])
    drawn = F.pmod(F.xxhash64(*[F.col(c) for c in (id_col, text_col) if c in labelled.columns]), F.lit(1 << 30)) < F.lit(1 << 30) * share[F.col(lang_col)]
    some = rows.where(drawn).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                for lang in set(langs := batch.column("lang").to_pylist()):
                    texts = [t for t, x in zip(_strings(batch, "text"), langs, strict=True) if x == lang]
                    keys, counts = counts_of(texts)
                    codes, counts = _counted(keys & ((1 << 44) - 1), counts)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], names=["lang", "code", "n"])

    counts = some.mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("r") <= size)
    profiles: dict[str, list[int]] = {}
    for lang, code, _ in sorted(top.select("lang", "code", "r").collect(), key=lambda x: (x[0], x[2])):
        profiles.setdefault(lang, []).append(code)
    return Profiles(profiles, size)


def predict(docs: DataFrame, profiles: Profiles, text_col="text") -> DataFrame:
    """docs with the columns lang_pred and score; their other columns are kept."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    rows = docs.select(held([c for c in docs.columns if c != text_col]).alias("_row"), F.col(text_col).alias("_text"))
    schema = extended(rows.schema, _lang="string", _score="double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text", SLICE):
                names, scores = shared.value.predict(_strings(batch, "_text"))
                yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_text"), pa.array(names, pa.string()), pa.array(scores)], names=["_row", "_text", "_lang", "_score"])

    kept = [F.col("_text").alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    return rows.mapInArrow(run, schema).select(*kept, F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
