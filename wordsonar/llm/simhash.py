"""SimHash near-duplicates: fingerprints of word shingles, and an exact tiled search for those within a radius.

Distinct fingerprints are laid out in tiles by population count (bits set, in all and in each byte). Two fingerprints
within the radius have counts within the radius, so a pair of tiles whose counts are further apart is skipped; of every
other pair all fingerprints are compared by exclusive-or and bit counts in numpy. Every link comes from such a pair of
tiles, at every size of the table.

What a pair of tiles has to compare is pruned first, without losing a link: of two fingerprints within `radius` bits, cut
into radius + 1 blocks of bits, one block is equal. So fingerprints are dealt to cells by the value of each of their
blocks, and tiles are cut from the fingerprints of a cell in the order of that value and of the counts; tiles without a
common value don't meet. Without it every tile would meet about half of all others: for 230 000 fingerprints 1.3e10
comparisons where now some 3e8 are made, growing with the square. A value with more fingerprints than a cell holds is
dealt further, a cell for each pair of parts whose counts are within the radius. A cell returns a spanning forest of its
links, not all links: a group of m near-copies gives at most m - 1 rows per cell and no link between components is lost.

Wide fingerprints (WORDS * 64 bits, of sets of hashes) tell likenesses of 0.8 from lesser ones, which 64 bits don't; they
are compared by the same tiles, laid out by a key and by the sets' sizes, and tiles whose sizes are too far apart are skipped.

Defined results: null and empty texts, and texts without words, have fingerprint zero and are linked like any others;
repeated rows give repeated result rows; a null id keeps its row, and takes the least id of its component (null if the
component has none); extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, mix, slices, utf8
from .components import components

#: Fingerprints in a cell (or in each of its two parts), and in a tile within it.
TILE, SMALL = 131072, 256
#: Words of 64 bits in a wide fingerprint, wide fingerprints in a tile, and hashes whose bits are summed at once.
WORDS, SIDE, BLOCK = 16, 128, 4096
_rng = np.random.default_rng(20261126)
_FACTORS = _rng.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The fingerprint of lower-cased UTF-8 bytes."""
    words = text.split()
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_digest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: n - 1] + 1))
    ends = ends[-n:]
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 16):
        pairs = zip(starts[i : i + (1 << 16)].tolist(), ends[i : i + (1 << 16)].tolist(), strict=True)
        h = np.frombuffer(b"".join([digest(line[a:b], 42) for a, b in pairs]), dtype=np.uint8)
        total += np.unpackbits(h).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                fps = [fingerprint(t.as_py().translate(_LOWER), shingle) for t in utf8(batch.column("text"))]
                fps = pa.array(np.array(fps, dtype=np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fps], names=["doc_id", "fp"])

    columns = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return columns.mapInArrow(run, "doc_id bigint, fp bigint")


def wide(sets: list[np.ndarray]) -> np.ndarray:
    """A row of WORDS words for each set of hashes: a bit is 1 if over half of the set's hashes, mixed anew for each word,
    have it. No set is empty."""
    every, sizes = np.concatenate(sets), np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    offset = np.arange(len(every)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ones = np.zeros((len(sets), 64 * WORDS), dtype=np.int32)
    for i in range(0, len(every), BLOCK):
        h = mix(every[i : i + BLOCK, None] * _FACTORS)
        # a byte for each bit, eight of them summed as one word: 255 rows at most
        lanes = np.unpackbits(h.view(np.uint8)).view(np.uint64).reshape(len(h), -1)
        cuts = np.flatnonzero(offset[i : i + BLOCK] % 255 == 0)
        cuts = cuts if len(cuts) and cuts[0] == 0 else np.concatenate(([0], cuts))
        ends, mine = np.append(cuts[1:], len(h)), owner[i + cuts]
        for a, b, k in zip(cuts.tolist(), ends.tolist(), mine.tolist(), strict=True):
            ones[k] += lanes[a:b].sum(axis=0).view(np.uint8)
    return np.packbits(2 * ones > sizes[:, None], axis=1).view(np.uint64)


class _Sized:
    """Wide fingerprints (some words of them) in the order of their keys and their sets' sizes, cut into tiles, each with
    its range of keys and of sizes."""

    def __init__(self, keys: np.ndarray, sizes: np.ndarray, fps: np.ndarray, rows: np.ndarray):
        self.rows = rows[np.lexsort((sizes[rows], keys[rows]))]
        self.keys, self.sizes, self.fps = keys[self.rows], sizes[self.rows], np.ascontiguousarray(fps[self.rows].T)
        cuts = np.arange(0, len(rows), SIDE)
        self.cuts = np.append(cuts, len(rows))
        self.low, self.high = np.minimum.reduceat(self.sizes, cuts), np.maximum.reduceat(self.sizes, cuts)
        self.first, self.last = self.keys[cuts], self.keys[self.cuts[1:] - 1]


def alike(keys: np.ndarray, sizes: np.ndarray, fps: np.ndarray, radius: np.ndarray, percent: int, left: np.ndarray, right: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of rows (one of left, one of right; right None: two of left) with the same key, whose sizes differ by no
    more than percent hundredths allow and whose fingerprints by no more than the greater radius of both, in portions."""
    if not len(left) or right is not None and not len(right):
        return
    a = _Sized(keys, sizes, fps, left)
    b = a if right is None else _Sized(keys, sizes, fps, right)
    for i in range(len(a.first)):
        start, end = np.searchsorted(b.last, a.first[i]), np.searchsorted(b.first, a.last[i], side="right")
        start = max(start, i) if a is b else start
        fit = (100 * b.high[start:end] >= percent * a.low[i]) & (100 * a.high[i] >= percent * b.low[start:end])
        x = slice(a.cuts[i], a.cuts[i + 1])
        for j in (np.flatnonzero(fit) + start).tolist():
            y = slice(b.cuts[j], b.cuts[j + 1])
            apart = np.zeros((x.stop - x.start, y.stop - y.start), dtype=np.uint16)
            for p, q in zip(a.fps[:, x], b.fps[:, y], strict=True):
                apart += np.bitwise_count(p[:, None] ^ q[None, :])
            most = max(radius[a.rows[x]].max(), radius[b.rows[y]].max())
            p, q = np.nonzero((apart <= most) & (a.keys[x][:, None] == b.keys[y][None, :]))
            m, n = a.sizes[x][p], b.sizes[y][q]
            near = (100 * np.minimum(m, n) >= percent * np.maximum(m, n)) & (apart[p, q] <= np.maximum(radius[a.rows[x][p]], radius[b.rows[y][q]]))
            p, q = p[near], q[near]
            if a is b and i == j:
                p, q = p[p < q], q[p < q]
            if len(p):
                yield a.rows[x][p], b.rows[y][q]


def _byte_counts(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8))


class _Laid:
    """Fingerprints in the order of their keys and population counts, cut into tiles, each with its range of keys and of
    counts (of all bits, and of each byte's)."""

    def __init__(self, fps: np.ndarray, keys: np.ndarray | None = None):
        counts = _byte_counts(fps).astype(np.int16)
        total = counts.sum(axis=1, dtype=np.int64)
        place = total << 32 | counts[:, 0].astype(np.int64) << 24 | counts[:, 1].astype(np.int64) << 16 | counts[:, 2].astype(np.int64) << 8 | counts[:, 3]
        keys = np.zeros(len(fps), dtype=np.int64) if keys is None else keys
        order = np.lexsort((place, keys))
        self.fps, self.keys = fps[order], keys[order]
        counts = np.column_stack((total, counts))[order].astype(np.int16)
        cuts = np.arange(0, len(fps), SMALL)
        self.low, self.high = np.minimum.reduceat(counts, cuts), np.maximum.reduceat(counts, cuts)
        self.cuts = np.append(cuts, len(fps))
        self.first, self.last = self.keys[self.cuts[:-1]], self.keys[self.cuts[1:] - 1]

    def tile(self, k: int) -> slice:
        return slice(self.cuts[k], self.cuts[k + 1])


def tile_pairs(left: _Laid, right: _Laid, radius: int) -> Iterator[tuple[int, int]]:
    """Pairs of tiles that have a key in common and whose counts are within the radius; of one layout each pair once."""
    for i in range(len(left.first)):
        a, b = np.searchsorted(right.last, left.first[i]), np.searchsorted(right.first, left.last[i], side="right")
        a = max(a, i) if left is right else a
        gap = np.maximum(0, np.maximum(left.low[i] - right.high[a:b], right.low[a:b] - left.high[i]))
        for j in np.flatnonzero((gap[:, 0] <= radius) & (gap[:, 1:].sum(axis=1) <= radius)) + a:
            yield i, int(j)


def _compared(left: _Laid, right: _Laid, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i, j in tile_pairs(left, right, radius):
        x, y = left.fps[left.tile(i)], right.fps[right.tile(j)]
        p, q = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
        same = left.keys[left.tile(i)][p] == right.keys[right.tile(j)][q]
        if left is right and i == j:
            same &= p < q
        if same.any():
            yield x[p[same]], y[q[same]]


def linked_pairs(a: np.ndarray, b: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of fingerprints (one of a, one of b; b None: two of a) within the radius, in portions."""
    left = _Laid(a)
    yield from _compared(left, left if b is None else _Laid(b), radius)


def dealt_pairs(keys: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of fingerprints with the same key within the radius, in portions."""
    laid = _Laid(fps, keys)
    yield from _compared(laid, laid, radius)


def forest(nodes: np.ndarray, portions: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A link from each linked node to its component's least one."""
    nodes = np.unique(nodes)
    root = np.arange(len(nodes))
    for p, q in portions:
        p, q = np.searchsorted(nodes, p), np.searchsorted(nodes, q)
        while True:
            x, y = root[p], root[q]
            apart = x != y
            if not apart.any():
                break
            p, q, x, y = p[apart], q[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (deeper := root[root]).tobytes() != root.tobytes():
                root = deeper
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def links(fps: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp) that join the same ones as all links within the radius."""
    blocks = max(2, radius + 1)
    width = -(-64 // blocks)
    part = lambda b: F.shiftrightunsigned("fp", b * width).bitwiseAND(F.lit((1 << width) - 1)) + (b << width)
    ones = F.bit_count("fp").cast("int").alias("ones")
    rows = fps.select("fp", ones, F.explode(F.array(*map(part, range(blocks)))).alias("key"))
    # blocks << width keys at most, whatever the number of fingerprints
    counted = Table(rows.groupBy("key").agg(F.count("*").alias("n")), "sizes")
    sizes = counted.df
    total, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("n")).first()
    hot = sizes.where(F.col("n") > tile).select("key") if (most or 0) > tile else None
    if hot is None:
        counted.drop()
    light = rows if hot is None else rows.join(hot, "key", "left_anti")
    cell = F.concat(F.lit("x"), F.pmod(F.xxhash64("key"), F.lit(-(-total // tile) or 1)).cast("string"))
    cells = light.select("fp", "key", cell.alias("cell"), F.lit(True).alias("same"), F.lit(False).alias("second"))
    if hot is not None:
        cells = cells.union(_tiles(rows.join(hot, "key"), radius, tile))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = pdf["fp"].to_numpy().view(np.uint64)
        if pdf["same"].iloc[0]:
            found = dealt_pairs(pdf["key"].to_numpy(), fps, radius)
        else:
            second = pdf["second"].to_numpy()
            if second.all() or not second.any():
                return pd.DataFrame({"u": [], "v": []}).astype("int64")
            found = linked_pairs(fps[~second], fps[second], radius)
        u, v = forest(fps, found)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return cells.groupBy("cell").applyInPandas(compare, "u bigint, v bigint")


def _tiles(rows: DataFrame, radius: int, tile: int) -> DataFrame:
    """Of keys with very many fingerprints: each class of a population count in tiles, and a cell for each pair of tiles
    whose counts are within the radius; a fingerprint goes to the cells of its tile."""
    classes = rows.groupBy("key", "ones").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    other = classes.select("key", F.col("ones").alias("other"), F.col("parts").alias("other_parts"))
    near = classes.join(other, "key").where(F.abs(F.col("ones") - F.col("other")) <= radius)  # 65 classes of a key at most
    mine = rows.join(near, ["key", "ones"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    cells = mine.select("fp", "key", "ones", "part", "other", F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1)).alias("other_part"))
    a, b = F.struct("ones", "part"), F.struct(F.col("other").alias("ones"), F.col("other_part").alias("part"))
    cells = cells.select("fp", "key", F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), (a > b).alias("second"))
    return cells.select("fp", "key", F.concat_ws(".", "key", "a.ones", "a.part", "b.ones", "b.part").alias("cell"), (F.col("a") == F.col("b")).alias("same"), "second")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", radius: int = 3, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the least doc_id that links of at most `radius` bits reach."""
    prints = Table(fingerprints(docs, id_col, text_col, shingle), "prints").df
    distinct = Table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct").df
    label = components(links(distinct, radius)).withColumnRenamed("node", "fp")
    named = distinct.join(label, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of = named.join(least, "label").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """The documents without those whose component has a smaller id. Of rows with the same id one stays,
    whatever their texts, so ids must be unique where no text may be lost (near.without_copies judges each text for itself);
    rows without an id stay."""
    found = near_duplicates(docs, id_col, text_col, **options)
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias(id_col)).distinct()
    # rows of a frequent id are one before the shuffle
    named = docs.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).join(keep, id_col, "left_semi")
    return named.select(docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
