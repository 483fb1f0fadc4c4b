"""Operators whose results are fixed, against plain versions."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SMALL
from wordsonar.llm import bpe, brown, common, multiset, queries, rlz, simhash, wumanber
from wordsonar.llm.components import components

from . import brute
from .conftest import EDGE

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def cut(texts):
    return [(len(w), len(w) - len(k), brute.sha(b" ".join(k))) for w, k in brute.kept_words(texts)]


def test_substring_dedup(spark, texts, edge, none):
    expected = [(i, *c) for (i, t), c in zip(texts, cut([t for _, t in texts]), strict=True)]
    columns = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert rows(queries.op4_rlz(spark, SMALL), *columns) == sorted(expected, key=repr)
    assert any(e[2] for e in expected)
    some = [(i, t) for i, t in EDGE]
    expected = [(i, *c) for (i, t), c in zip(some, cut([t for _, t in some]), strict=True)]
    assert rows(rlz.report(edge), *columns) == sorted(expected, key=repr)
    assert rlz.report(none).count() == 0


def test_substring_dedup_texts(edge, none):
    kept = {r.row: r.text for r in rlz.without_repeats(edge).collect()}
    for k, ((_, t), (w, left)) in enumerate(zip(EDGE, brute.kept_words([t for _, t in EDGE]), strict=True)):
        assert kept[k] == (t if len(left) == len(w) else b" ".join(left).decode())
    assert rlz.without_repeats(edge).columns == edge.columns and rlz.without_repeats(none).count() == 0


def test_substring_dedup_random(spark):
    r = random.Random(2)
    for window, letters in ((10, "ab"), (12, "abc")):
        made = [" ".join(r.choice(letters) for _ in range(r.randint(0, 120))) for _ in range(12)]
        df = spark.createDataFrame(list(enumerate(made)), "doc_id bigint, text string")
        found = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in rlz.report(df, window=window).collect()}
        for k, (w, left) in enumerate(brute.kept_words(made, window)):
            assert found[k] == (len(w), len(w) - len(left), brute.sha(b" ".join(left)))


def test_word_hashes(monkeypatch):
    text = ("ab cd\x0bé  " * 50 + "x" * 90 + " ab").encode()
    whole = common.word_hashes(text)
    assert len(whole) == len(text.split()) and whole[0] == whole[-1] and len(set(whole.tolist())) == 4
    monkeypatch.setattr(common, "CHUNK_BYTES", 37)
    assert (common.word_hashes(text) == whole).all() and len(common.word_hashes(b" \n")) == 0


def test_simhash(spark, texts, edge, none):
    columns = ("doc_id", "fingerprint", "component_id")
    assert rows(queries.op9_simhash(spark, SMALL), *columns) == sorted(brute.components(texts), key=repr)
    assert rows(simhash.near_duplicates(edge), *columns) == sorted(brute.components(EDGE), key=repr)
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_links():
    r = np.random.default_rng(3)
    centres = r.integers(0, 2**63, 40, dtype=np.uint64)
    flips = np.uint64(1) << r.integers(0, 64, (40, 50, 2), dtype=np.uint64)
    fps = np.unique(np.concatenate((centres, (centres[:, None] ^ flips[:, :, 0] ^ flips[:, :, 1]).ravel())))
    for a, b in ((fps, None), (fps[::2], fps[1::2])):
        found = {frozenset((x, y)) for p, q in simhash.linked_pairs(a, b, 3) for x, y in zip(p.tolist(), q.tolist(), strict=True)}
        other = a if b is None else b
        assert found == {frozenset((x, y)) for x in a.tolist() for y in other.tolist() if x != y and (x ^ y).bit_count() <= 3}
    nodes, roots = simhash.forest(fps, simhash.linked_pairs(fps, None, 3))
    assert len(nodes) <= len(fps) - 1 and (roots < nodes).all()


def test_simhash_tiles(spark):
    r = random.Random(4)
    base = [r.getrandbits(63) for _ in range(20)]
    fps = sorted({b ^ (1 << r.randrange(63)) ^ (1 << r.randrange(63)) for b in base for _ in range(30)})
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    label = {x.node: x.label for x in components(simhash.links(df, 3, tile=16)).collect()}
    group = brute.groups(fps)
    pairs = {(label.get(f, f), g) for f, g in zip(fps, group, strict=True)}
    assert len(pairs) == len({a for a, _ in pairs}) == len(set(group))


def test_one_of_each(edge):
    kept = simhash.one_of_each(edge)
    expected = {i for i, _, c in brute.components(EDGE) if i is not None and i == c}
    got = [r.doc_id for r in kept.collect()]
    assert {x for x in got if x is not None} == expected and got.count(None) == 2 and len(got) == len(expected) + 2 and kept.columns == edge.columns


@pytest.mark.parametrize("kind", ["chain", "star", "random", "none"])
def test_components(spark, kind):
    r = random.Random(1)
    links = {"chain": [(k, k + 1) for k in range(200)], "star": [(500, k) for k in range(300)], "random": [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(None, 1), (7, 7)], "none": []}[kind]
    found = {x.node: x.label for x in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    graph = {}
    for u, v in links:
        if u is not None and u != v:
            graph.setdefault(u, set()).add(v)
            graph.setdefault(v, set()).add(u)
    expected = {}
    for node in sorted(graph):
        stack = [node]
        while stack:
            x = stack.pop()
            if x not in expected:
                expected[x] = expected.get(node, node)
                stack += graph[x]
    assert found == expected


def report_of(rows_):
    return sorted(((d, n, h, len(f), brute.sha(",".join(sorted(map(str, f)))), c) for d, n, h, f, c in rows_), key=repr)


DECONTAMINATED = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_decontaminate(spark, texts, edge, none):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    expected = report_of(brute.decontaminated(texts, items))
    assert rows(queries.op10_decontaminate(spark, SMALL), *DECONTAMINATED) == expected and any(r[-1] for r in expected)
    short = [(1, "same words"), (2, "LA la"), (3, None), (4, " ! "), (5, "p1 p2 p3 p4 p5 p6 p7"), (6, " ".join(f"P{k}" for k in range(20, 40))), (7, "é"), (1, "same words"), (None, "a")]
    bench = spark.createDataFrame(short, "item_id bigint, text string")
    expected = brute.decontaminated(EDGE, [(i, t) for i, t in short if i is not None])
    assert rows(wumanber.report(edge, bench), *DECONTAMINATED) == report_of(expected)
    kept = wumanber.clean(edge, bench)
    assert kept.columns == edge.columns and sorted(r.row for r in kept.collect()) == [k for k, e in enumerate(expected) if not e[-1]]
    assert wumanber.report(none, bench).count() == 0 and not any(r.contaminated for r in wumanber.report(edge, bench.limit(0)).collect())


def test_decontaminate_in_shards(spark, texts, docs, monkeypatch):
    monkeypatch.setattr(wumanber, "SHARD_BYTES", 2000)
    monkeypatch.setattr(wumanber, "ROUNDS", 2)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert rows(wumanber.report(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet")), *DECONTAMINATED) == report_of(brute.decontaminated(texts, items))


def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def test_bpe(spark, texts, edge, none):
    encoding = library()

    def expected(some):
        ids = [(i, encoding.encode_ordinary(t or ""), t or "") for i, t in some]
        return sorted(((i, len(x), brute.sha(" ".join(map(str, x))), brute.sha(t)) for i, x, t in ids), key=repr)

    columns = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert rows(queries.op6_byte_bpe(spark, SMALL), *columns) == expected(texts)
    coded = bpe.encode(edge, PATH, PATTERN)
    assert rows(coded, *columns) == expected(EDGE) and bpe.encode(none, PATH, PATTERN).count() == 0
    assert sorted(r.ids for r in coded.where("doc_id in (5, 10)").collect()) == sorted(encoding.encode_ordinary(t) for i, t in EDGE if i in (5, 10))


def test_bpe_pieces():
    r, encoding = random.Random(1), library()
    coder = bpe.Coder(PATH, PATTERN, cache=50)
    some = ["a" * 700, "ab" * 400, "".join(r.choice("abcde") for _ in range(600)), "it's we'll DON'T \t\n", "!" * 300 + "=-" * 100, " " * 400 + "x", "ﬁ x² ¼ ªº", "x\xady", "\x85\u2028 \x1d", "<|endoftext|>", ""]
    some += ["".join(r.choice("the quick brown\n'1é") for _ in range(80)) for _ in range(60)]
    for text in some:
        lines = coder.encode([text])
        assert lines == [" ".join(map(str, encoding.encode_ordinary(text)))] and coder.decode(lines) == [text.encode()]
        assert list(coder.both([text, text])) == 2 * [(lines[0], text.encode())]


def test_bpe_memory():
    memory = bpe.Memory(6)
    for k in range(40):
        here = {0, k, k // 2}
        for new in memory.missing(here):
            memory[new] = str(new)
        assert all(memory[x] == str(x) for x in here) and len(memory) + len(memory.elder) < 13


def lm_tokens(text):
    return [w.translate(brute.LOWER) for w in brute.words(text)] + [b"\n"]


def check_scores(found, some, trained):
    counts = Counter(w for t in trained for w in lm_tokens(t))
    n, v = sum(counts.values()), len(counts)
    expected = []
    for i, t in some:
        w = lm_tokens(t)
        expected.append((i, len(w), sum(x in counts for x in w), n, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found), key=repr)
    for a, b in zip(got, sorted(expected, key=repr), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)


def test_class_bigrams(spark, texts):
    found = queries.op3_brown(spark, SMALL).collect()
    aside = {i for i, _ in texts if zlib.crc32(str(i).encode()) % 5 == 1}
    check_scores(found, texts, [t for i, t in texts if i not in aside])
    assert {r.doc_id for r in found if r.held_out} == aside
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("head", [3, 100_000])
def test_class_bigrams_edges(edge, none, head):
    check_scores(brown.score(edge, brown.learn(edge, top=50, classes=5, head=head)).collect(), EDGE, [t for _, t in EDGE])
    assert brown.score(none, brown.learn(none)).count() == 0
    assert all(r.n_known == 0 and math.isfinite(r.score) for r in brown.score(edge, brown.learn(none)).collect())


def test_most_frequent(spark):
    made = {str(k).encode(): 5000 // (k + 1) for k in range(3000)}
    df = spark.createDataFrame(list(made.items()), "word binary, n bigint")
    order = sorted(made, key=lambda w: (-made[w], w))
    words, counts = brown.most_frequent(df, 500)
    assert 400 < len(words) < 600 and words[:300] == order[:300] and counts[:300] == [made[w] for w in order[:300]]
    assert brown.most_frequent(df, 5000)[0] == order and brown.most_frequent(df.limit(0), 5) == ([], [])


def test_class_bigrams_are_a_distribution(spark):
    r = random.Random(8)
    made = [" ".join(r.choice(("aa bb cc", "xx yy zz")[k % 2].split()) for _ in range(30)) for k in range(40)]
    model = brown.learn(spark.createDataFrame([(t,) for t in made], "text string"), top=20, classes=4)
    words = model.head
    for before in range(4):
        total = sum((n + 0.5) * 10 ** model.pairs[before, model.classes.of(w)] for w, n in zip(words, model.head_counts, strict=True))
        assert 0.5 < total <= 1 + 1e-9
    assert len({model.classes.of(w) for w in (b"aa", b"bb", b"cc")} & {model.classes.of(w) for w in (b"xx", b"yy", b"zz")}) == 0


def test_exchange_raises_likelihood():
    r = np.random.default_rng(0)
    group = r.integers(0, 3, 31)
    pairs = r.poisson(np.where((group[:, None] + 1) % 3 == group[None, :], 6.0, 0.3))

    def likelihood(of):
        table = np.array([[pairs[np.ix_(of == a, of == b)].sum() for b in range(4)] for a in range(4)], dtype=float)
        log = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return log(table) - log(table.sum(axis=1)) - log(table.sum(axis=0))

    of = brown.exchange(pairs, 4)
    start = np.append(np.arange(30) % 3, 3)
    assert likelihood(of) >= max(likelihood(np.append(r.permutation(start[:-1]), 3)) for _ in range(50)) and likelihood(of) >= likelihood(np.append(group[:-1], 3)) - 1e-6


def edited(some):
    """(id, characters, edited text, next text) in the order of ids."""
    order = sorted(some, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    out = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 4
        out.append((i, len(t), brute.sha(t[: len(t) - cut] + after[:cut])))
    return out


def test_multiset(spark, texts, edge, none):
    found = queries.op8_multiset(spark, SMALL)
    assert rows(found, "doc_id", "n_chars", "edited_sha256") == sorted(edited(texts), key=repr)
    assert rows(multiset.report(edge), "doc_id", "n_chars", "edited_sha256") == sorted(edited(EDGE), key=repr)
    assert multiset.report(none).count() == 0
    text = dict(texts)
    prints = {r.doc_id: r.fingerprint for r in found.collect()}
    assert len(set(prints.values())) == len(set(text.values())) == len({(prints[i], t) for i, t in text.items()})
    means = found.agg(F.avg("near_edited"), F.avg("near_next"), F.min("near_next"), F.max("near_edited")).first()
    assert means[0] > 0.5 and means[1] < 0.2 and means[2] >= 0 and means[3] <= 1


def test_multiset_across_ranges(spark, texts, monkeypatch):
    monkeypatch.setattr(multiset, "RANGE", 7)
    for name in (lambda i: i * i, lambda i: 2**62 if i == 5 else i - 30, lambda i: 7 if 10 < i < 40 else i):
        some = [(name(i), t) for i, t in texts[:60]]
        df = spark.createDataFrame(some, "doc_id bigint, text string")
        assert rows(multiset.report(df), "doc_id", "n_chars", "edited_sha256") == sorted(edited(some), key=repr)
        sizes = [r["count"] for r in multiset._ranges(df)[0].groupBy("range").count().collect()]
        assert len(sizes) > 4 and max(sizes) < 45


def test_multiset_is_homomorphic(spark):
    df = spark.createDataFrame([("ab", "one, two.\nthree"), ("ba", "three\none, two."), ("a", "one, two."), ("b", "three"), ("other", "three\none, two")], "k string, text string")
    prints = {r.k: r.lanes for r in multiset.fingerprints(df, "text", "k").collect()}
    assert prints["ab"] == prints["ba"] != prints["other"]
    pair = spark.createDataFrame([(prints["a"], prints["b"], prints["ab"])], "a array<bigint>, b array<bigint>, ab array<bigint>")
    row = pair.select(multiset.combine(F.col("a"), F.col("b")).alias("sum"), multiset.combine(F.col("ab"), F.col("b"), -1).alias("less")).first()
    assert row["sum"] == prints["ab"] and row["less"] == prints["a"]


def test_bpe_lets_its_coder_go(monkeypatch):
    monkeypatch.setattr(bpe, "IDLE", 0.2)
    with bpe.coder_of(PATH, PATTERN) as one:
        time.sleep(0.4)
        assert one.encode(["a word"])
    with bpe.coder_of(PATH, PATTERN) as two:
        assert two is one
    time.sleep(0.6)
    assert not bpe._coders


def test_simhash_blocks():
    r = np.random.default_rng(6)
    fps = r.integers(0, 2**63, 3000, dtype=np.uint64)
    fps = np.unique(np.concatenate((fps, fps[:300] ^ (np.uint64(1) << r.integers(0, 64, 300, dtype=np.uint64)))))
    keys = (fps >> np.uint64(50)).astype(np.int64) % 40
    found = {frozenset((x, y)) for p, q in simhash.dealt_pairs(keys, fps, 3) for x, y in zip(p.tolist(), q.tolist(), strict=True)}
    few = {frozenset((x, y)) for p, q in simhash.dealt_pairs(keys * 1000 + np.arange(len(keys)) % 7, fps, 40) for x, y in zip(p.tolist(), q.tolist(), strict=True)}
    by = {}
    for k, f in zip(keys.tolist(), fps.tolist(), strict=True):
        by.setdefault(k, []).append(f)
    assert found == {frozenset((x, y)) for own in by.values() for i, x in enumerate(own) for y in own[:i] if (x ^ y).bit_count() <= 3} and found
    by = {}
    for i, (k, f) in enumerate(zip(keys.tolist(), fps.tolist(), strict=True)):
        by.setdefault((k, i % 7), []).append(f)
    assert few == {frozenset((x, y)) for own in by.values() for i, x in enumerate(own) for y in own[:i] if (x ^ y).bit_count() <= 40}


@pytest.mark.parametrize("radius", [0, 1, 2, 5])
def test_simhash_radius(spark, radius):
    r = random.Random(radius)
    fps = sorted({b ^ sum(1 << x for x in r.sample(range(63), r.randint(0, 6))) for b in [r.getrandbits(63) for _ in range(15)] for _ in range(20)})
    label = {x.node: x.label for x in components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint"), radius)).collect()}
    pairs = {(label.get(f, f), g) for f, g in zip(fps, brute.groups(fps, radius), strict=True)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({g for _, g in pairs})


@pytest.mark.parametrize("window", [10, 35])
def test_parse_into_factors(spark, texts, window):
    """Every factor stands at its source, factors don't overlap, and with the boundary windows they cover what recurs."""
    r = random.Random(window)
    made = [" ".join(r.choice("ab") for _ in range(r.randint(0, 120))) for _ in range(12)] + ["same row of words " * 12] * 2 if window == 10 else [t for _, t in texts]
    df = spark.createDataFrame([(i // 2 * 2 + i % 2 if t != made[-1] else 99, t) for i, t in enumerate(made)], "doc_id bigint, text string")
    words = {i: brute.words(t) for i, t in ((x.doc_id, x.text) for x in df.collect())}
    starts = {}
    for i, w in words.items():
        for k in range(len(w) - window + 1):
            starts.setdefault(tuple(w[k : k + window]), set()).add((i, k))
    found = rlz.factors(df, window=window).collect()
    twins = {99} if window == 10 else set()
    covered, lengths = {}, {}
    for f in found:
        w = words[f.doc_id]
        assert f.length >= window and f.start + f.length <= len(w)
        covered.setdefault(f.doc_id, set()).update(range(f.start, f.start + f.length))
        if f.boundary:
            for k in range(f.start, f.start + f.length - window + 1):
                assert len(starts[tuple(w[k : k + window])]) > 1 or f.doc_id in twins
            continue
        assert w[f.start : f.start + f.length] == words[f.source_id][f.source_start : f.source_start + f.length]
        assert (f.doc_id, f.start) != (f.source_id, f.source_start) or f.doc_id in twins
        lengths.setdefault(f.doc_id, []).append((f.start, f.length))
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if len(starts[tuple(w[k : k + window])]) > 1 or i in twins:
                gone.update(range(k, k + window))
        assert covered.get(i, set()) == gone
        own = sorted(lengths.get(i, []))
        assert all(a + n <= b for (a, n), (b, _) in zip(own, own[1:]))
        # a greedy parse that tries every source has factors at least as long in all
        best, k = 0, 0
        while k < len(w):
            n = window if len(starts.get(tuple(w[k : k + window]), ())) > 1 else 0
            while n and k + n < len(w) and any(words[j][p : p + n + 1] == w[k : k + n + 1] for j, p in starts[tuple(w[k : k + window])] if (j, p) != (i, k)):
                n += 1
            best += n > 0
            k += n or 1
        if i not in twins:
            assert (best > 0) == bool(own) and len(own) <= 3 * best
    assert any(not f.boundary for f in found)


def test_class_bigrams_by_brute_force(spark):
    """Counts of classes, sizes and every score from the classes that the model names, token by token, whether a word is in
    the list that goes to every task or in the table only."""
    r = random.Random(12)
    made = [" ".join(r.choice("Aa bb cc ddd eee xx yy zzz one two three four".split()) for _ in range(r.randrange(25))) for _ in range(60)] + ["", None]
    learned, asked = spark.createDataFrame([(t,) for t in made], "text string"), [(k, t) for k, t in enumerate(made[:20] + ["aa never seen bb", "Xx\u00a0yy", None])]
    for head in (4, 1000):
        model = brown.learn(learned, top=5, classes=4, head=head)
        kind = {r.w: (r.n, r.c) for r in model.known.collect()}
        key = lambda w: int(brown.hashes_of([w]).view(np.int64)[0])
        counts = Counter(w for t in made for w in lm_tokens(t))
        assert {key(w): n for w, n in counts.items()} == {w: n for w, (n, _) in kind.items()}
        of = lambda w: kind[key(w)][1] if key(w) in kind else model.seen.of(w)
        moves = np.zeros((4, 4))
        for t in made:
            w = lm_tokens(t)
            for a, b in zip([brown.END, *w], w):
                moves[model.seen.of(a), of(b)] += 1
        types = np.bincount([of(w) for w in counts], minlength=4)
        total, distinct = sum(counts.values()), len(counts)
        for row in brown.score(spark.createDataFrame(asked, "doc_id bigint, text string"), model).collect():
            w, score = lm_tokens(dict(asked)[row.doc_id]), 0.0
            for a, b in zip([brown.END, *w], w):
                x, c = model.seen.of(a), of(b)
                by_class = (moves[x, c] + 0.5) / (moves[x].sum() + 2) * (counts[b] + 0.5) / (moves[:, c].sum() + 0.5 * (types[c] + 1))
                score += math.log10(0.9 * by_class + 0.1 * (counts[b] + 0.5) / (total + 0.5 * (distinct + 1)))
            assert row.score == pytest.approx(score, rel=1e-9)


def test_every_word_moves_to_its_likeliest_class():
    r = np.random.default_rng(5)
    moves, befores = r.integers(0, 50, (6, 6)).astype(float), r.integers(0, 4, (200, 6)).astype(float)
    moves[:, 5] = 0  # a class without words takes none
    e = r.integers(0, 5, 200)
    found = brown._Exchange(moves, 1).of(befores, befores.sum(axis=1), e)
    for row, c in zip(befores, found, strict=True):
        each = [sum(k * math.log((moves[h, x] + 0.5) / (moves[:, x].sum() + 3)) for h, k in enumerate(row)) for x in range(5)]
        assert each[c] >= max(each) - 1e-9
    assert (brown._Exchange(moves, 10**6).of(befores, befores.sum(axis=1), e) == e).all()


def lanes_of(text):
    """The sums of a text's fingerprint by brute force."""
    text = text or ""
    strong = [sum(int(brute.sha(p)[8 * k : 8 * k + 8], 16) for p in text.split("\n")) % 2**32 for k in range(6)]
    pieces = [p.strip(" ") for p in re.findall(r"[^.!?,;:|\n]{1,16}", text)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces if p]
    return strong + [len(h)] + [sum(x >> k & 1 for x in h) for k in range(64)]


def alike(a, b):
    if a == b:
        return 1.0
    x, y = ([2 * c - v[6] for c in v[7:]] for v in (a, b))
    norm = math.sqrt(sum(c * c for c in x) * sum(c * c for c in y))
    return min(1.0, max(0.0, sum(p * q for p, q in zip(x, y, strict=True)) / norm)) if norm else 0.0


@pytest.mark.parametrize("table", ["documents", "edge"])
def test_multiset_by_brute_force(spark, texts, edge, table):
    """Every fingerprint and both likenesses."""
    some = texts if table == "documents" else EDGE
    found = (queries.op8_multiset(spark, SMALL) if table == "documents" else multiset.report(edge)).collect()
    order = sorted(some, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    shown = lambda v: "".join(f"{x:08x}" for x in v)
    expected = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 4
        own, edit, other = lanes_of(t), lanes_of(t[: len(t) - cut] + after[:cut]), lanes_of(after)
        expected.append((i, shown(own), shown(edit), round(alike(own, edit), 9), round(alike(own, other), 9)))
    got = [(r.doc_id, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in found]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    if table == "documents":
        long = [(e[3], e[4]) for e, (_, t) in zip(expected, order, strict=True) if len(t or "") > 200]
        # what is mostly one repeated line, in one of both only, has its likeness by that line's share
        assert sum(a > 0.5 for a, _ in long) >= 0.95 * len(long) and sum(a > b for a, b in long) >= 0.98 * len(long)


def test_multiset_of_very_many_pieces(spark):
    """Lanes of a text of more than 2 ** 20 pieces don't run over."""
    text = "a.b.c\n" * 400_000
    df = spark.createDataFrame([("x", text), ("y", "a.b.c\n" * 399_999), ("z", "a.b.c\n")], "k string, text string")
    prints = {r.k: r.lanes for r in multiset.fingerprints(df, "text", "k").collect()}
    assert prints["x"][6] == 1_200_000
    pair = spark.createDataFrame([(prints["y"], prints["z"])], "a array<bigint>, b array<bigint>")
    both = pair.select(multiset.combine(F.col("a"), F.col("b")).alias("sum")).first()["sum"]
    assert both[6:] == prints["x"][6:]
