"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of `window` consecutive words of a benchmark item (an item of fewer words is one shorter
window). Patterns of one length class share a shift table keyed by a block of words: the table says how far the search
may jump because no pattern ends there; where it says 0, a bucket chosen by the suffix block lists the patterns that
end in it, and these are compared word by word. A document is read once for all patterns, in the task that holds it,
without any shuffle.

Defined results: null and empty texts have no words; null and empty items have no window; repeated items and repeated
documents count each for themselves; an empty benchmark leaves every document clean; a document with a null id is
searched like any other; items with a null id are searched by clean, not by report, whose SQL leaves them out; item ids
of any type count as their strings. Columns of the inputs other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, extended, held, utf8

#: Upper-case ASCII goes to lower case, what is not part of a word to a space; bytes from 0x80 on belong to words.
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)

#: Bytes of benchmark text in one set of tables (which take some hundred times as many); more items are searched in further
#: rounds over the documents.
SHARD_BYTES = 2 << 20
#: Rounds within one task, each with a worker and tables of its own; then the documents are written and read again.
ROUNDS = 4


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Tables:
    """Shift and bucket tables for patterns whose lengths lie in one class."""

    def __init__(self, patterns: dict[tuple, list[str | None]]):
        self.least = min(map(len, patterns))
        self.block = min(2, self.least)
        self.jump = self.least - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, list[tuple]] = {}
        for p in patterns:
            # only the last `least` words steer the search
            tail = p[len(p) - self.least :]
            for end in range(self.block, self.least + 1):
                key, by = tail[end - self.block : end], self.least - end
                if by < self.shift.get(key, self.jump):
                    self.shift[key] = by
            self.buckets.setdefault(p[len(p) - self.block :], []).append(p)
        self.patterns = patterns

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int, list[str | None]]]:
        """(start, end, items) of every occurrence."""
        shift, jump, block, i, n = self.shift.get, self.jump, self.block, self.least, len(words)
        while i <= n:
            key = tuple(words[i - block : i])
            by = shift(key, jump)
            if by:
                i += by
                continue
            for p in self.buckets[key]:
                if len(p) <= i and tuple(words[i - len(p) : i]) == p:
                    yield i - len(p), i, self.patterns[p]
            i += 1


def build(items: list[tuple[str | None, bytes]], window: int = 13) -> list[Tables]:
    """Tables by length class: full windows, then shorter items by powers of two, lest one short item slow all."""
    classes: dict[int, dict[tuple, dict[str | None, None]]] = {}
    for item, text in items:
        words = words_of(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            p = tuple(words[i : i + n])
            classes.setdefault(window if n == window else n.bit_length() - 100, {}).setdefault(p, {})[item] = None
    return [Tables({p: list(found) for p, found in own.items()}) for own in classes.values()]


_STATE = ["_spans", "_items"]


def _round(docs: DataFrame, shared, first: bool, finish=None, schema=None) -> DataFrame:
    """Searches the texts in _text for one set of tables. Found spans and items go to the columns _spans and _items,
    or with those of former rounds to finish(batch, words of each text, spans, items), which gives the result's batch."""
    out = schema or extended(docs.schema, _spans="array<int>", _items="array<string>") if first or schema else docs.schema
    kept = [c for c in docs.columns if c not in _STATE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in batches:
            counts, spans, items = [], [], []
            old = None if first else [batch.column(c).to_pylist() for c in _STATE]
            for k, text in enumerate(utf8(batch.column("_text"))):
                words = words_of(text.as_py())
                hits, seen = ([], set()) if first else (list(old[0][k]), set(old[1][k]))
                for t in tables:
                    for a, b, found in t.search(words):
                        if hits and hits[-2] <= a <= hits[-1]:
                            hits[-1] = max(hits[-1], b)
                        else:
                            hits += (a, b)
                        seen.update(found)
                counts.append(len(words))
                spans.append(hits)
                items.append(list(seen))
            if finish:
                yield finish(batch, counts, spans, items)
            else:
                state = [pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + state, names=kept + _STATE)

    return docs.mapInArrow(run, out)


def find(docs: DataFrame, benchmark: DataFrame, item_id="item_id", item_text="text", window: int = 13, finish=None, schema=None, unnamed: bool = False) -> DataFrame:
    """docs, whose texts are in _text, with _spans (flat start, end pairs, in words) and _items (ids of the items that
    occur), or what `finish` makes of them.

    The benchmark goes to the executors in shards of about SHARD_BYTES of text, so what is broadcast has a bound
    whatever the table's size; each further shard is one more round, ROUNDS of them within the same tasks.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("t is not null" if unnamed else "t is not null and i is not null")
    size = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    shards = -(-size // SHARD_BYTES) or 1
    written, sent = None, []
    for k in range(shards):
        part = items if shards == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(shards)) == k)
        shared = spark.sparkContext.broadcast(build(sorted(((r[0], r[1].encode()) for r in part.toLocalIterator()), key=lambda x: (x[0] is None, x[0] or "", x[1])), window))
        sent.append(shared)
        docs = _round(docs, shared, k == 0, *((finish, schema) if k == shards - 1 else ()))
        if k % ROUNDS == ROUNDS - 1 and k < shards - 1:
            done = Table(docs, "rounds")
            if written:
                written.drop()
            for tables in sent:
                tables.unpersist()
            docs, written, sent = done.df, done, []
    return docs


def covered(spans: list[int]) -> int:
    """Words in the union of spans."""
    total = reach = 0
    for a, b in sorted(zip(spans[0::2], spans[1::2], strict=True)):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


def report(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", share: int = 20, **options) -> DataFrame:
    """One row per document: its words, hit words, items found, their digest, and whether it is contaminated
    (at least one in `share` of its words is hit)."""
    schema = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"

    def finish(batch, counts, spans, items):
        hit = [covered(s) for s in spans]
        named = [hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in items]
        bad = [h > 0 and share * h >= n for h, n in zip(hit, counts, strict=True)]
        columns = [pa.array(counts, pa.int64()), pa.array(hit, pa.int64()), pa.array(list(map(len, items)), pa.int64()), pa.array(named, pa.string()), pa.array(bad, pa.bool_())]
        return pa.RecordBatch.from_arrays([batch.column("_id"), *columns], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    docs = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
    return find(docs, benchmark, finish=finish, schema=schema, **options)


def clean(docs: DataFrame, benchmark: DataFrame, text_col="text", share: int = 20, window: int = 13, whole: bool = False, **options) -> DataFrame:
    """The documents that aren't contaminated, with all their columns; rows stay in their task, nothing is shuffled. A
    document is contaminated if one in `share` of its words is hit; with `whole` also if a run of `window` words is hit,
    however long the document: then no window of an item is left, and short items alone are judged by their share."""
    rows = docs.select(held([c for c in docs.columns if c != text_col]).alias("_row"), F.col(text_col).alias("_text"))

    def finish(batch, counts, spans, items):
        hit = [covered(s) for s in spans]
        long = [whole and any(b - a >= window for a, b in zip(s[0::2], s[1::2], strict=True)) for s in spans]
        keep = [not (x or h > 0 and share * h >= n) for x, h, n in zip(long, hit, counts, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_text")], names=["_row", "_text"]).filter(pa.array(keep, pa.bool_()))

    out = find(rows, benchmark, window=window, finish=finish, schema=rows.schema, unnamed=True, **options)
    return out.select(*[F.col("_text").alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in docs.columns])
