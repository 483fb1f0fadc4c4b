"""Near-duplicates by SimHash of word shingles, in tiles, with exact confirmation by the sets of shingles.

The similarity of two texts is the Jaccard similarity of their sets of runs of `shingle` words (a shorter text is one
run). Texts with the same set are one node. A node's fingerprint is a wide SimHash of its set (simhash.wide, 1024 bits).
Sets of similarity s have bits that differ with a chance of acos(2s / (1 + s)) / pi at most, 0.152 at 0.8 (0.161 for sets
of 4 to 48 shingles, 0.188 for 4 against 5; computed). Nodes are dealt to cells by each of BANDS blocks of BITS bits, and tiles
within a cell (simhash.alike) compare all fingerprints whose block is equal and whose sizes 0.8 allows, by exclusive-or
and bit counts. Two texts of similarity 0.8 share no block with a chance of 6e-6 (3e-5 for few shingles, 1e-3 for 4 against 5),
and are further apart than the radius, 4.5 deviations over the mean, with one of 4e-6 for each comparison. What is within
the radius is confirmed by the sets themselves, so no text goes for a likeness below the threshold.

All nodes meet by 128 bits first, which counts each one's links (its crowd); the others are done with. Then each node names
one other: of each cell's links the one of most crowd, and of these the one that most cells name. That finds the original
of a group of copies that are less like each other. Confirmed copies go, so a large group gives as many pairs as it has
members. That is done STARS times; only what is left meets in pairs, by all bits. So of two texts that stay none is a near
copy of the other, and each that goes is a near copy of another one, which stays unless it is one of a third itself; of two
alike, with as many links, the lesser (id, text) stays. Up to the last step a block value with more than MOST nodes
compares all of them with MOST of them only, and counts all as linked; the last step compares everything, and a value with
more than simhash.TILE nodes is dealt further, a cell for each pair of parts. Texts are shuffled once, to the nodes with links.

Defined results: null and empty texts, and texts without words, are copies of each other; rows without an id stay and
take nothing out; extra columns are kept. Sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import Runs, Table, fresh, mix, signed, slices, utf8, word_hashes

#: Blocks of a fingerprint by which nodes meet, and the bits of each; its words that cells compare at first.
BANDS, BITS, FIRST = 80, 12, 2
#: Nodes of one block value that all others are compared with before the last step.
MOST = 8192
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Rounds in which each node meets one other only.
STARS = 2


def shingles(text: bytes, size: int = 5) -> np.ndarray:
    """The hashes of a text's distinct shingles, in order; a text without words has one."""
    words = word_hashes(text.translate(_LOWER))
    if not len(words):
        return np.zeros(1, dtype=np.uint64)
    starts = np.arange(max(1, len(words) - size + 1))
    return np.unique(Runs(words, 3).of(starts, np.minimum(starts + size, len(words))))


def radius(sizes: np.ndarray, bits: int, percent: int) -> np.ndarray:
    """Differing bits, of `bits`, that sets of these sizes have at most with others of a likeness of `percent` hundredths."""
    chance = np.arccos(2 * percent / (100 + percent)) / np.pi + np.where(sizes < 6, 0.037, np.where(sizes < 48, 0.01, 0.003))
    return (bits * chance + 4.5 * np.sqrt(bits * chance * (1 - chance))).astype(np.uint16)


def _signed(texts: DataFrame, size: int) -> DataFrame:
    """(id, h, node, n, sig) of (id, h, text)."""
    names = ["id", "h", "node", "n", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = [shingles(t.as_py(), size) for t in utf8(batch.column("text"))]
                node = pa.array(signed(np.array([mix(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)))
                sig = pa.array([row.tobytes() for row in simhash.wide(sets)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), node, pa.array(list(map(len, sets)), pa.int32()), sig], names=names)

    return texts.mapInArrow(run, "id bigint, h bigint, node bigint, n int, sig binary")


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """(h, set) of (h, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = [signed(shingles(t.as_py(), size)) for t in utf8(batch.column("text"))]
                ends = pa.array(np.cumsum([0] + list(map(len, sets))), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("h"), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets)))], names=["h", "set"])

    return texts.mapInArrow(run, "h bigint, set array<bigint>")


def _sift(pairs: DataFrame, percent: int) -> DataFrame:
    """(u, v) of (u, v, a, b, m, n) whose fingerprints a and b, of sets of m and n, are within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (_words(batch.column(c)) for c in "ab")
                sizes = np.minimum(*(batch.column(c).to_numpy() for c in "mn"))
                near = pa.array(np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= radius(sizes, 64 * a.shape[1], percent))
                yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(near)

    return pairs.mapInArrow(run, "u bigint, v bigint")


def _words(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(column), -1)


def _confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> Table:
    """(node) for each v of pairs (u, v) that is a near copy of u."""
    sig = lambda end, name, n: nodes.select(F.col("node").alias(end), F.col("sig").alias(name), F.col("n").alias(n))
    alike = _sift(pairs.join(sig("u", "a", "m"), "u").join(sig("v", "b", "n"), "v"), percent)
    of = lambda end, name: sets.select(F.col("node").alias(end), F.col("set").alias(name))
    both = F.size(F.array_intersect("a", "b")).cast("bigint")
    near = (100 + percent) * both >= percent * (F.size("a") + F.size("b"))
    return Table(alike.join(of("u", "a"), "u").join(of("v", "b"), "v").where(near).select(F.col("v").alias("node")).distinct(), "copies")


def _keys(sigs: list[bytes]) -> np.ndarray:
    """A row of each fingerprint's BANDS keys: the block's number and its bits."""
    bits = np.unpackbits(np.frombuffer(b"".join(sigs), dtype=np.uint8)).reshape(len(sigs), -1)[:, : BANDS * BITS].reshape(len(sigs), BANDS, BITS)
    return (bits.astype(np.int32) << np.arange(BITS, dtype=np.int32)).sum(axis=2, dtype=np.int32) + (np.arange(BANDS, dtype=np.int32) << BITS)


def _dealt(nodes: DataFrame, words: int, pairs: bool) -> DataFrame:
    """Nodes (id, node, n, sig, crowd) under the key of each of their blocks, with `words` words of the fingerprint, in cells
    of about simhash.TILE rows. A key with more rows has several: each node is in one of them, or with `pairs` in those of
    all pairs of parts that hold its own (second: the node is of the second part; same: all rows of a key that meet are here)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BANDS << BITS, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(_keys(batch.column("sig").to_pylist()).ravel(), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["key", "k"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                sigs = batch.column("sig").to_pylist()
                each = pa.array(np.repeat(np.arange(len(sigs)), BANDS))
                some = pa.array([x[: 8 * words] for x in sigs], pa.binary())
                out = [pa.array(_keys(sigs).ravel()), *(batch.column(c).take(each) for c in ("id", "node", "n", "crowd")), some.take(each)]
                yield pa.RecordBatch.from_arrays(out, names=["key", "id", "node", "n", "crowd", "sig"])

    # BANDS << BITS keys at most, whatever the number of nodes
    sizes = Table(nodes.select("sig").mapInArrow(count, "key int, k bigint").groupBy("key").agg(F.sum("k").alias("k")), "sizes")
    total = sizes.df.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    hot = sizes.df.where(F.col("k") > simhash.TILE).select("key", F.ceil(F.col("k") / simhash.TILE).cast("int").alias("parts"))
    rows = nodes.select("id", "node", "n", "crowd", "sig").mapInArrow(deal, "key int, id bigint, node bigint, n int, crowd bigint, sig binary")
    cell = F.concat(F.lit("x"), F.pmod(F.xxhash64("key"), F.lit(-(-total // simhash.TILE) or 1)).cast("string"))
    if hot.isEmpty():
        return rows.select("*", cell.alias("cell"), F.lit(True).alias("same"), F.lit(False).alias("second"))
    # a key in `hot` has over TILE of all rows, so there are few
    rows = rows.join(F.broadcast(hot), "key", "left").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    light = rows.where("parts is null").select("key", "id", "node", "n", "crowd", "sig", cell.alias("cell"), F.lit(True).alias("same"), F.lit(False).alias("second"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)) if pairs else F.col("part")
    heavy = rows.where("parts is not null").select("*", other.alias("other"))
    same = F.col("part") == F.col("other") if pairs else F.lit(False)
    heavy = heavy.select("key", "id", "node", "n", "crowd", "sig", F.concat_ws(".", "key", F.least("part", "other"), F.greatest("part", "other")).alias("cell"), same.alias("same"), F.expr("part > other").alias("second"))
    return light.union(heavy)


def _columns(table: pa.Table) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in ("key", "id", "node", "n", "crowd")] + [_words(table.column("sig"))]


def _links(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Of a cell's rows: their places in the order of crowd and id, which of them have a key of more than MOST rows (or of
    more than one cell), and the links (p, q), both ways; of those keys only the links to MOST rows of the highest places."""
    key, ids, node, n, crowd, fps = _columns(table)
    order = np.lexsort((-node, -ids, crowd))
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    by = np.lexsort((-place, key))
    starts = np.flatnonzero(np.append(True, key[by][1:] != key[by][:-1]))
    runs = np.diff(np.append(starts, len(by)))
    hot, chosen = np.zeros(len(by), dtype=bool), np.zeros(len(by), dtype=bool)
    hot[by] = np.repeat(runs, runs) > MOST
    hot |= ~table.column("same").to_numpy()
    chosen[by] = np.arange(len(by)) - np.repeat(starts, runs) < MOST
    most = radius(n, 64 * fps.shape[1], percent)

    def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for p, q in simhash.alike(key, n, fps, most, percent, np.flatnonzero(~hot)):
            yield np.concatenate((p, q)), np.concatenate((q, p))
        for p, q in simhash.alike(key, n, fps, most, percent, np.flatnonzero(hot), np.flatnonzero(hot & chosen)):
            yield p[p != q], q[p != q]

    return place, hot, found()


def _crowds(cells: DataFrame, percent: int) -> DataFrame:
    """(node, crowd) of the nodes with links: their number in all cells."""

    def run(table: pa.Table) -> pa.Table:
        place, hot, links = _links(table, percent)
        crowd = np.zeros(len(place), dtype=np.int64)
        for p, _ in links:
            crowd += np.bincount(p, minlength=len(crowd))
        met = np.flatnonzero((crowd > 0) | hot)
        return pa.table({"node": table.column("node").take(pa.array(met)), "crowd": crowd[met]})

    return cells.groupBy("cell").applyInArrow(run, "node bigint, crowd bigint").groupBy("node").agg(F.sum("crowd").alias("crowd"))


def _named(cells: DataFrame, percent: int) -> DataFrame:
    """(u, v): for each node v with links the node u that it names."""

    def run(table: pa.Table) -> pa.Table:
        place, _, links = _links(table, percent)
        best = np.full(len(place), -1, dtype=np.int64)
        for p, q in links:
            up = place[q] > place[p]
            np.maximum.at(best, p[up], place[q[up]])
        v = np.flatnonzero(best >= 0)
        u = np.argsort(place)[best[v]]
        of = lambda c, at: table.column(c).take(pa.array(at))
        return pa.table({"v": of("node", v), "u": of("node", u), "crowd": of("crowd", u), "low": pc.negate(of("id", u))})

    every = cells.groupBy("cell").applyInArrow(run, "v bigint, u bigint, crowd bigint, low bigint")
    cells_of = every.groupBy("v", "u", "crowd", "low").agg(F.count("*").alias("cells"))
    return cells_of.groupBy("v").agg(F.max_by("u", F.struct("cells", "crowd", "low", "u")).alias("u")).select("u", "v")


def _pairs(cells: DataFrame, percent: int) -> DataFrame:
    """(u, v): every link, v of the greater (id, node)."""

    def run(table: pa.Table) -> pa.Table:
        key, ids, node, n, _, fps = _columns(table)
        second = table.column("second").to_numpy()
        left, right = (np.arange(len(key)), None) if table.column("same")[0].as_py() else (np.flatnonzero(~second), np.flatnonzero(second))
        u, v = [node[:0]], [node[:0]]
        for p, q in simhash.alike(key, n, fps, radius(n, 64 * fps.shape[1], percent), percent, left, right):
            less = (ids[p] < ids[q]) | (ids[p] == ids[q]) & (node[p] < node[q])
            u.append(node[np.where(less, p, q)])
            v.append(node[np.where(less, q, p)])
        both = np.unique(np.column_stack((np.concatenate(u), np.concatenate(v))), axis=0)
        return pa.table({"u": both[:, 0], "v": both[:, 1]})

    return cells.groupBy("cell").applyInArrow(run, "u bigint, v bigint").distinct()


def copies(nodes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The nodes (id, h, node, n, sig) without near copies of others."""
    # a smaller set has no other that is near enough
    able = nodes.where(F.col("n") * (100 - percent) >= percent).withColumn("crowd", F.lit(0).cast("bigint"))
    crowds = _crowds(_dealt(able, FIRST, False), percent)
    some = Table(nodes.join(crowds, "node"), "met")
    # one text of each node, by its hash
    rows = texts.select("h", "text").join(some.df.select("h").distinct(), "h", "left_semi").dropDuplicates(["h"])
    sets = Table(some.df.select("node", "h").join(_sets(rows, size), "h").select("node", "set"), "sets")
    gone: list[Table] = []
    left = some.df
    for _ in range(STARS):
        held = Table(_named(_dealt(left, FIRST, False), percent), "stars")
        # of a chain of pairs no two neighbours go: who is named by another stays, for now
        went = _confirmed(held.df.join(held.df.select(F.col("u").alias("v")).distinct(), "v", "left_anti"), some.df, sets.df, percent)
        held.drop()
        gone.append(went)
        left = left.join(went.df, "node", "left_anti")
    pairs = Table(_pairs(_dealt(left, simhash.WORDS, True), percent), "pairs")
    gone.append(_confirmed(pairs.df, some.df, sets.df, percent))
    for table in (pairs, sets, some):
        table.drop()
    for table in gone:
        nodes = nodes.join(table.df, "node", "left_anti")
    return nodes


def without_copies(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near copies (a similarity of `percent` hundredths or more) of others."""
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    rows = Table(_signed(texts, shingle), "signed").df
    best = rows.groupBy("node").agg(F.min(F.struct("id", "h")).alias("best"), F.min("n").alias("n"), F.min("sig").alias("sig"))
    nodes = Table(best.select("best.id", "best.h", "node", "n", "sig"), "nodes").df
    kept = copies(nodes, texts, shingle, percent)
    # a row of its own text: rows with an id but other texts are judged each for themselves
    h = fresh("_h", docs.columns)
    keep = kept.select(F.col("id").alias(id_col), F.col("h").alias(h))
    # repeated rows are one before the shuffle
    named = docs.where(F.col(id_col).isNotNull()).withColumn(h, F.xxhash64(text_col)).dropDuplicates([id_col, h])
    return named.join(keep, [id_col, h], "left_semi").select(docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
