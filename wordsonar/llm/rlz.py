"""Substring dedup by relative Lempel-Ziv parsing against reference blocks.

The reference is every document, indexed in blocks. A block is the text around an anchor: of the `gram`-word runs inside a
window of `window` words the one with the least hash is the window's anchor, so equal windows have equal anchors at equal
places, and each window belongs to the block of one anchor. The index has, of each block that occurs again, its least and
its greatest place (document, word); of blocks that share an anchor but differ, it has the same for every single window.

Each document is parsed from left to right. Where a window stands in the index, a factor begins: it goes on, block by block
and window by window, as long as its source goes on with the same words, tried for both places and taken for the one
that goes further (the least place if both end together). A factor is (start, length, source document, source start), has
`window` words at least, and the parse goes on behind it; words without a factor are literals. At a factor's end the
windows that reach across it are looked up one by one: one that stands in the index from another source is a boundary
window. Factors and boundary windows are the duplicate spans: together they cover exactly the words of recurring windows.

The plan: anchors of all documents (about 2 in 29 words) are counted by key with partial aggregation; only anchors that
occur again go on, so the tables shrink to what is repeated. Equal blocks are counted together before anything else,
so a passage with very many copies is one row of the index. Texts are never shuffled whole: they travel compressed, once
to the few documents whose blocks differ from others of their anchor, and once to their spans.

Defined results: null texts have no words; windows are judged on the input, so every copy of a repeated window loses it,
the first one too, and repeats within a document count; a document shorter than the window loses nothing; repeated rows
repeat each other's windows (their factors' source is the document itself, at the same place: its twin); null ids are kept
as they are; extra columns are not read. Words are compared by 64-bit hashes; blocks and windows by two independent
64-bit hashes of theirs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Runs, Table, fresh, mix, signed, slices, utf8, word_hashes

GRAM = 8
_PLACE = np.uint64((1 << 24) - 1)


class Blocks:
    """The anchors of one document's words, and for each the first and last window (by start) that it holds."""

    def __init__(self, words: np.ndarray, window: int, gram: int = GRAM):
        self.words, n = words, len(words) - window + 1
        self.at = np.zeros(0, dtype=np.int64)
        if n < 1:
            return
        grams = len(words) - gram + 1
        starts = np.arange(grams)
        keys = Runs(words, 1).of(starts, starts + gram)
        span = window - gram + 1
        order = mix(keys ^ np.uint64(0x9E3779B97F4A7C15)) & ~_PLACE
        found = []
        # places are 24 bits of the sort key: longer documents in parts that overlap
        part = int(_PLACE) + 1 - span
        for a in range(0, n, part):
            b = min(n, a + part)
            low = order[a : b + span - 1] | np.arange(b - a + span - 1, dtype=np.uint64)
            k = 1
            while 2 * k <= span:
                low = np.minimum(low[:-k], low[k:])
                k *= 2
            if k < span:
                low = np.minimum(low[: b - a], low[span - k : span - k + b - a])
            found.append((low & _PLACE).astype(np.int64) + a)
        holder = np.concatenate(found)
        self.first = np.flatnonzero(np.concatenate(([True], holder[1:] != holder[:-1])))
        self.last = np.append(self.first[1:], n) - 1
        self.at = holder[self.first]
        self.keys = keys[self.at]
        self.window = window

    def contents(self) -> np.ndarray:
        """A hash of each block: its words, and where in it the anchor and the windows lie."""
        shape = ((self.at - self.first) << 32 | (self.last - self.first)).astype(np.uint64)
        return mix(Runs(self.words, 4).of(self.first, self.last + self.window) ^ mix(shape))


def _held(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and a key of both: rows that are equal share it, and all that it stands for."""
    i, t = F.col(id_col).cast("bigint"), F.col(text_col)
    return docs.select(F.xxhash64(i, t).alias("key"), i.alias("id"), t.alias("text"))


_NAMES = ["anchor", "content", "key", "first", "count"]


def _anchors(held: DataFrame, window: int) -> DataFrame:
    """(anchor, content, key, first, count): the blocks of all documents; a block holds `count` windows from the word
    `first` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                parts = []
                for key, text in zip(batch.column("key").to_pylist(), utf8(batch.column("text")), strict=True):
                    b = Blocks(word_hashes(text.as_py()), window)
                    if len(b.at):
                        parts.append((signed(b.keys), signed(b.contents()), np.full(len(b.at), key), b.first.astype(np.int32), (b.last - b.first + 1).astype(np.int32)))
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=_NAMES)

    return held.select("key", "text").mapInArrow(run, "anchor bigint, content bigint, key bigint, first int, count int")


def _pack(held: DataFrame, *columns: str) -> DataFrame:
    """The texts compressed, for a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = pa.array([pack.compress(t.as_py()) for t in utf8(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [packed], names=[*columns, "packed"])

    return held.select(*columns, "text").mapInArrow(run, ", ".join(f"{c} bigint" for c in columns) + ", packed binary")


_WINDOW = "anchor bigint, content bigint, hash bigint, key bigint, at int, alone boolean"


def _windows(packed: DataFrame, window: int) -> DataFrame:
    """(anchor, content, hash, key, at, alone): the single windows of the blocks named in the column blocks of (key,
    blocks, packed); they start at the word `at`, and are alone if their block occurs once."""

    names = ["anchor", "content", "hash", "key", "at", "alone"]

    def rows(key: int, text: bytes, blocks: list[dict]) -> tuple:
        words = word_hashes(text)
        anchor, content, first, counts, n = (np.array([b[c] for b in blocks], dtype=np.int64) for c in ("anchor", "content", "first", "count", "n"))
        at = np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        there = at + window <= len(words)  # others belong to a text whose key has the same hash
        at = at[there]
        hashes = signed(Runs(words, 2).of(at, at + window))
        return np.repeat(anchor, counts)[there], np.repeat(content, counts)[there], hashes, np.full(len(at), key), at.astype(np.int32), np.repeat(n == 1, counts)[there]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            parts, size = [], 0
            for key, blocks, text in zip(batch.column("key").to_pylist(), batch.column("blocks").to_pylist(), batch.column("packed"), strict=True):
                parts.append(rows(key, unpack.decompress(text.as_py()), blocks))
                size += len(parts[-1][0])
                if size > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=names)
                    parts, size = [], 0
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=names)

    return packed.mapInArrow(run, _WINDOW)


#: A run of windows that stand in the index: the first one's word, their number, the least and the greatest place of the first.
_RUN = ["at", "count", "key1", "at1", "key2", "at2"]


def duplicate_blocks(docs: DataFrame, id_col="doc_id", text_col="text", window: int = 35) -> DataFrame:
    """(key, runs), in a table: what the index says of each document with recurring windows, as an array of runs (at,
    count, key1, at1, key2, at2): the `count` windows from the word `at` on occur from the word at1 of document key1
    on, and from at2 of key2 (the least and the greatest place; one of them may be the run's own)."""
    if window - GRAM + 1 > 64:
        raise ValueError("a window of more than 71 words: a block would hold more than 64 windows, the most that are looked up for one")
    rows = _held(docs, id_col, text_col)
    blocks = Table(_anchors(rows, window), "anchors")
    again = blocks.df.groupBy("anchor").agg(F.count("*").alias("n"), F.min("content").alias("a"), F.max("content").alias("b")).where("n > 1").select("anchor", (F.col("a") == F.col("b")).alias("whole"))
    # a table of its own, so that a frequent anchor's blocks can be split in the join
    anchors = Table(again, "again")
    again = Table(blocks.df.join(anchors.df, "anchor"), "blocks")
    blocks.drop()
    anchors.drop()
    place = F.struct("key", "first", "count")
    contents = again.df.groupBy("anchor", "content", "whole").agg(F.count("*").alias("n"), F.min(place).alias("one"), F.max(place).alias("other"))
    kinds = Table(contents, "contents")
    contents = kinds.df
    # where blocks of an anchor differ, one of each kind shows its windows
    one = F.struct("anchor", "content", "one.first", "one.count", "n")
    ends = contents.where("not whole").groupBy("one.key").agg(F.collect_list(one).alias("blocks"))
    shown = Table(_windows(_pack(rows, "key").join(ends, "key").select("key", "blocks", "packed"), window).distinct(), "windows")
    windows = shown.df
    place = F.struct("key", "at")
    seen = windows.groupBy("anchor", "hash").agg(F.count("*").alias("kinds"), F.min(place).alias("a"), F.max(place).alias("b")).where("kinds > 1").drop("kinds")
    single = windows.where("alone").join(seen, ["anchor", "hash"]).select("key", "at", F.lit(1).alias("count"), "a.key", "a.at", "b.key", "b.at")
    index = contents.where("n > 1").select("anchor", "content", "one", "other")
    whole = again.df.join(index, ["anchor", "content"]).select("key", "first", "count", "one.key", "one.first", "other.key", "other.first")
    found = whole.union(single).toDF("key", *_RUN).groupBy("key").agg(F.collect_set(F.struct(*_RUN)).alias("runs"))
    found = Table(found, "runs").df
    for table in (again, kinds, shown):
        table.drop()
    return found


def parse(runs: np.ndarray, key: int, window: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """The factors (start, length, source key, source start) of a document, from left to right, and its boundary windows
    as (first start, number). runs: rows of _RUN."""
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    # windows with sources that go on alike are one run
    step = runs[:-1, 1]
    on = (runs[1:, 0] == runs[:-1, 0] + step) & (runs[1:, 2] == runs[:-1, 2]) & (runs[1:, 3] == runs[:-1, 3] + step) & (runs[1:, 4] == runs[:-1, 4]) & (runs[1:, 5] == runs[:-1, 5] + step)
    heads = np.flatnonzero(np.concatenate(([True], ~on)))
    counts = np.add.reduceat(runs[:, 1], heads)
    at, sources = runs[heads, 0].tolist(), runs[heads, 2:].tolist()
    ends = (runs[heads, 0] + counts).tolist()
    twin = [(k1, p1) == (k2, p2) for k1, p1, k2, p2 in sources]

    def reach(i: int, source: int, place: int) -> int:
        """The run behind the last one that goes on with the source, which begins run i at a place."""
        while i + 1 < len(at) and at[i + 1] == ends[i]:
            place += ends[i] - at[i]
            if (source, place) not in ((sources[i + 1][0], sources[i + 1][1]), (sources[i + 1][2], sources[i + 1][3])):
                break
            i += 1
        return i + 1

    factors, edges, i, here = [], [], 0, 0
    while i < len(at):
        if at[i] < here:  # windows that begin in the factor before and end behind it
            edges.append((at[i], min(ends[i], here) - at[i]))
            if ends[i] <= here:
                i += 1
                continue
        begin = max(at[i], here)
        k1, p1, k2, p2 = sources[i]
        places = [(k, p) for k, p in ((k1, p1), (k2, p2)) if twin[i] or (k, p) != (key, at[i])]
        reached = [reach(i, k, p) for k, p in places]
        best = reached.index(max(reached))
        (k, p), after = places[best], reached[best]
        factors.append((begin, ends[after - 1] - begin + window - 1, k, p + begin - at[i]))
        here = begin + factors[-1][1]
        i = after
    return factors, edges


def _parsed(runs: list[dict], key: int, window: int):
    return parse(np.array([[r[c] for c in _RUN] for r in runs], dtype=np.int64), key, window)


def removed_words(n: int, factors: list, edges: list, window: int) -> np.ndarray:
    """True for each of n words that a factor or a boundary window covers."""
    spans = [(a, a + length) for a, length, _, _ in factors] + [(a, a + count - 1 + window) for a, count in edges]
    # what ends beyond the text belongs to one whose key has the same hash
    spans = np.array([x for x in spans if x[1] <= n], dtype=np.int64).reshape(-1, 2)
    edge = np.bincount(spans[:, 0], minlength=n + 1) - np.bincount(spans[:, 1], minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def _judged(docs: DataFrame, id_col: str, text_col: str, window: int, *columns: str) -> DataFrame:
    runs = duplicate_blocks(docs, id_col, text_col, window)
    return _pack(_held(docs, id_col, text_col), *columns).join(runs, "key", "left")


def _kept(text: bytes, key: int, runs, window: int) -> tuple[int, list[bytes]]:
    words = text.split()
    if not runs:
        return len(words), words
    gone = removed_words(len(words), *_parsed(runs, key, window), window)
    return len(words), [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def factors(docs: DataFrame, id_col="doc_id", text_col="text", window: int = 35) -> DataFrame:
    """(doc_id, start, length, source_id, source_start, boundary): the parse of each document, a row for each factor; with
    boundary a row for each run of boundary windows, whose source is not named. Equal rows have one parse."""
    schema = "key bigint, start int, length int, source bigint, source_start int, boundary boolean"
    names = ["key", "start", "length", "source", "source_start", "boundary"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, runs in zip(batch.column("key").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                found, edges = _parsed(runs, key, window)
                rows += [(key, *f, False) for f in found] + [(key, a, count - 1 + window, None, None, True) for a, count in edges]
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=_FACTOR)

    found = duplicate_blocks(docs, id_col, text_col, window).mapInArrow(run, schema)
    ids = _held(docs, id_col, text_col).select("key", "id").distinct()
    named = found.join(ids.withColumnRenamed("id", "doc_id"), "key").join(ids.select(F.col("key").alias("source"), F.col("id").alias("source_id")), "source", "left")
    return named.select("doc_id", "start", "length", "source_id", "source_start", "boundary")


_FACTOR = pa.schema([("key", pa.int64()), ("start", pa.int32()), ("length", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32()), ("boundary", pa.bool_())])


def report(docs: DataFrame, id_col="doc_id", text_col="text", window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            counts, removed, digests = [], [], []
            for key, text, runs in zip(batch.column("key").to_pylist(), batch.column("packed"), batch.column("runs"), strict=True):
                n, kept = _kept(unpack.decompress(text.as_py()), key, runs.as_py(), window)
                counts.append(n)
                removed.append(n - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    judged = _judged(docs, id_col, text_col, window, "key", "id")
    return judged.select("key", "id", "packed", "runs").mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def without_repeats(docs: DataFrame, id_col="doc_id", text_col="text", window: int = 35) -> DataFrame:
    """docs with the repeated words cut from their texts; a text that loses none stays as it is, else the kept words are
    joined by one space. Null texts stay null."""
    columns = docs.columns
    key, runs = fresh("_key", columns), fresh("_runs", columns)
    rows = docs.withColumn(key, F.xxhash64(F.col(id_col).cast("bigint"), F.col(text_col)))
    found = duplicate_blocks(docs, id_col, text_col, window).select(F.col("key").alias(key), F.col("runs").alias(runs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for k, text, its in zip(batch.column(key).to_pylist(), batch.column(text_col), batch.column(runs), strict=True):
                text, its = text.as_py(), its.as_py()
                texts.append(b" ".join(_kept(text.encode(), k, its, window)[1]).decode() if its else text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in columns], names=columns)

    return rows.join(found, key, "left").select(*columns, key, runs).mapInArrow(run, docs.schema)
