"""Near copies of the pipeline's stage against similarities by brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.conftest import SMALL
from wordsonar.llm import near, simhash

from .conftest import EDGE


def shingles(text):
    w = [x.lower() for x in (text or "").encode().split()]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def check(rows, kept):
    """No two that stay are near copies, and each that goes is one of another row."""
    rows = sorted(set(rows), key=repr)
    sets = {r: shingles(r[1]) for r in rows}
    assert set(kept) <= set(rows) and len(kept) == len(set(kept))
    for k, a in enumerate(kept):
        assert all(similarity(sets[a], sets[b]) < 0.8 for b in kept[:k])
    for a in set(rows) - set(kept):
        assert any(b != a and similarity(sets[a], sets[b]) >= 0.8 for b in rows)


@pytest.mark.parametrize("table", ["documents", "edge"])
def test_whole_tables(spark, texts, table):
    rows = texts if table == "documents" else [r for r in EDGE if r[0] is not None]
    found = near.without_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    check(rows, [(r.doc_id, r.text) for r in found])


def test_near_copies_go(spark):
    r = random.Random(5)
    rows = []
    for k in range(60):
        words = [f"w{r.randrange(5000)}" for _ in range(200)]
        rows.append((2 * k, " ".join(words)))
        for at in (40, 110, 170)[: k % 4]:
            words[at] = "other"
        rows.append((2 * k + 1, " ".join(words)))
    sets = [shingles(t) for _, t in rows]
    assert all(similarity(sets[k], sets[k + 1]) >= 0.8 for k in range(0, 120, 2))
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), SMALL).collect()
    assert sorted(x.doc_id for x in kept) == list(range(0, 120, 2))


def test_texts_under_one_id(spark):
    base = " ".join(f"a{k}" for k in range(300))
    rows = [(3, base), (5, base + " more"), (5, "a text of its own that is found nowhere else"), (5, base + " more")]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), SMALL).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [rows[0], rows[2]]


def test_a_group_whose_members_are_alike_through_one_only(spark, monkeypatch):
    """Copies of one text that are less like each other meet it, whatever its id, and not each other."""
    r = random.Random(7)
    base = [f"b{k}" for k in range(400)]
    rows = [(70, " ".join(base))]
    for k in range(60):
        words = list(base)
        for at in r.sample(range(20, 380), 6):
            words[at] = f"x{k}"
        rows.append((k, " ".join(words)))
    sets = [shingles(t) for _, t in rows]
    assert all(similarity(sets[0], x) >= 0.8 for x in sets[1:]) and sum(similarity(sets[1], x) >= 0.8 for x in sets[2:]) < 5
    counted, confirmed = [], near._confirmed
    monkeypatch.setattr(near, "_confirmed", lambda pairs, *rest: counted.append(pairs.count()) or confirmed(pairs, *rest))
    kept = near.without_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert [x.doc_id for x in kept] == [70] and sum(counted) <= 2 * len(rows)


def some_sets(seed=3):
    """Sets of hashes in families, whose members differ in more and more."""
    r = np.random.default_rng(seed)
    sets = []
    for size in (4, 5, 9, 30, 250, 300, 700):
        base = r.integers(0, 2**64, size, dtype=np.uint64)
        for other in (0, 1, size // 12, size // 5, size // 2):
            sets.append(np.unique(np.concatenate((base[other:], r.integers(0, 2**64, other, dtype=np.uint64)))))
    return [np.frombuffer(x, dtype=np.uint64) for x in dict.fromkeys(x.tobytes() for x in sets)]


def jaccard(a, b):
    both = len(np.intersect1d(a, b))
    return both / (len(a) + len(b) - both)


def table(sets, keys):
    fps = simhash.wide(sets)
    of = {"key": keys, "id": range(len(sets)), "node": range(len(sets)), "n": map(len, sets), "crowd": [0] * len(sets)}
    return pa.table({c: pa.array(list(x), pa.int64()) for c, x in of.items()} | {"sig": pa.array([x.tobytes() for x in fps], pa.binary()), "same": pa.array([True] * len(sets))})


def test_wide_fingerprints():
    """A bit is what over half of the hashes have, also in sets that end within a block of hashes and go over several."""
    r = np.random.default_rng(4)
    sets = [r.integers(0, 2**64, k, dtype=np.uint64) for k in (1, 2, 254, 255, 256, 3000, 511, 9000, 4, 4096)]
    for s, fp in zip(sets, simhash.wide(sets), strict=True):
        for w in range(simhash.WORDS):
            each = simhash.mix(s * simhash._FACTORS[w]).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(each, axis=1).sum(axis=0, dtype=np.int64)
            assert fp[w : w + 1].view(np.uint8).tobytes() == np.packbits(2 * bits > len(s)).tobytes()


def test_tiles_lose_no_pair():
    """Of every two rows with one key all that are within the radius are found, and they hold all near copies."""
    sets = some_sets() * 9
    r = np.random.default_rng(6)
    keys, fps, n = r.integers(0, 3, len(sets)), simhash.wide(sets), np.array([len(s) for s in sets])
    most = near.radius(n, 1024, 80)
    found = {(min(a, b), max(a, b)) for p, q in simhash.alike(keys, n, fps, most, 80, np.arange(len(sets))) for a, b in zip(p.tolist(), q.tolist(), strict=True)}
    expected, true = set(), set()
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            if keys[a] == keys[b] and 100 * min(n[a], n[b]) >= 80 * max(n[a], n[b]):
                if np.bitwise_count(fps[a] ^ fps[b]).sum() <= max(most[a], most[b]):
                    expected.add((a, b))
                if jaccard(sets[a], sets[b]) >= 0.8:
                    true.add((a, b))
    assert found == expected and true <= found and len(true) > len(sets)
    half = np.arange(len(sets)) % 2 == 0
    crossed = {(min(a, b), max(a, b)) for p, q in simhash.alike(keys, n, fps, most, 80, np.flatnonzero(half), np.flatnonzero(~half)) for a, b in zip(p.tolist(), q.tolist(), strict=True)}
    assert crossed == {(a, b) for a, b in expected if half[a] != half[b]}


def test_a_frequent_block(monkeypatch):
    """Of a key with more than MOST rows all count as linked, and links lead to the first of them only."""
    sets = some_sets()
    rows = table(sets, [0] * len(sets))
    every = [set(zip(p.tolist(), q.tolist(), strict=True)) for p, q in near._links(rows, 80)[2]]
    monkeypatch.setattr(near, "MOST", 8)
    place, hot, found = near._links(rows, 80)
    some = {x for p, q in found for x in zip(p.tolist(), q.tolist(), strict=True)}
    assert hot.all() and some == {(p, q) for p, q in set().union(*every) if place[q] >= len(sets) - 8} and some


@pytest.mark.parametrize("tile", [simhash.TILE, 7])
def test_blocks_and_cells(spark, monkeypatch, tile):
    """The fingerprints' blocks bring all near copies together, also where a block's rows are dealt to pairs of parts."""
    monkeypatch.setattr(simhash, "TILE", tile)
    sets = some_sets() + some_sets(8)
    rows = table(sets, [0] * len(sets)).drop_columns(["key", "same"]).to_pylist()
    nodes = spark.createDataFrame(rows, "id bigint, node bigint, n int, crowd bigint, sig binary")
    found = [(r.u, r.v) for r in near._pairs(near._dealt(nodes, simhash.WORDS, True), 80).collect()]
    true = {(a, b) for b in range(len(sets)) for a in range(b) if jaccard(sets[a], sets[b]) >= 0.8}
    assert len(found) == len(set(found)) and true <= set(found) and true
    linked = {r.node for r in near._crowds(near._dealt(nodes, near.FIRST, False), 80).collect()}
    assert {x for pair in true for x in pair} <= linked


def test_near_dedup_finds_candidates_by_simhash(spark, monkeypatch):
    """Every pair that the stage confirms is one of fingerprints within the radius."""
    r = random.Random(11)
    rows = []
    for k in range(30):
        words = [f"w{r.randrange(9000)}" for _ in range(r.choice((8, 60, 300)))]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words + ["more"]))]
    seen, confirmed = [], near._confirmed

    def counted(pairs, *rest):
        seen.extend(pairs.collect())
        return confirmed(pairs, *rest)

    monkeypatch.setattr(near, "_confirmed", counted)
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), SMALL).collect()
    sets = [near.shingles(t.encode()) for _, t in rows]
    node = {int(near.signed(np.array([near.mix(s).sum(dtype=np.uint64)]))[0]): k for k, s in enumerate(sets)}
    fps, n = simhash.wide(sets), np.array([len(s) for s in sets])
    for x in seen:
        a, b = node[x.u], node[x.v]
        assert np.bitwise_count(fps[a, : near.FIRST] ^ fps[b, : near.FIRST]).sum() <= near.radius(n[[a, b]], 64 * near.FIRST, 80).max()
    assert seen and sorted(x.doc_id for x in kept) == list(range(0, 60, 2))
