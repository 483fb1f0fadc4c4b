"""Queries over whole tables that have no SQL, against the plain functions."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from wordsonar import queries
from wordsonar.functions import keyboard, phonetic
from wordsonar.operators import index


def terms(spark, source):
    """The ids of each word, by the index, which has SQL of its own."""
    found = {}
    for r in index.postings(queries.table(spark, SMALL, source)).collect():
        found.setdefault(r.term, set()).add(r.id)
    return found


def plain(query, target):
    m, n, key = len(query), len(target), keyboard.KEY_OF
    d = [[2 * (i + j) for j in range(n + 1)] for i in range(m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            step, a, b = (1 if i == m else 2), query[i - 1], target[j - 1]
            d[i][j] = min(d[i - 1][j] + step, d[i][j - 1] + step, d[i - 1][j - 1] + keyboard.cost(a, b))
            if i > 1 and j > 1 and a in key and query[i - 2] in key and key.get(target[j - 2]) == key[a] and key.get(b) == key[query[i - 2]]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 2)
    return d[m][n]


def test_keyboard_distance_of_every_length(spark):
    found = {r.term: r.d for r in queries.queries()["keyboard_distance_all"](spark, SMALL).collect()}
    assert found == {t: plain("WIDGTE", t) for t in terms(spark, queries.PARTS)} and len({len(t) for t in found}) > 1


def test_sound_of_documents(spark):
    run = lambda name: queries.queries()[name](spark, SMALL).collect()
    words = terms(spark, queries.DOCS)
    keys = {t: phonetic.keys_str(t) for t in words}
    found = {r.term: (r.language, r.approx) for r in run("phonetic_keys_documents")}
    assert found == {t: (phonetic.language_str(t), (k or [""])[0]) for t, k in keys.items()}
    pairs = {(k, i) for t, ids in words.items() for k in keys[t] for i in ids}
    assert pairs and {(r.term, r.id) for r in run("phonetic_index_documents")} == pairs
    sizes = Counter(k for own in keys.values() for k in own)
    [r] = run("key_distribution_documents")
    assert (r.source, r.unique_keys, r.links, r.max_bucket) == (len(words), len(sizes), sizes.total(), max(sizes.values()))
    best = sorted(sizes.items(), key=lambda x: (-x[1], x[0]))[:15]
    assert sorted((r.key, r.n) for r in run("largest_buckets_documents")) == sorted(best)
    assert len(run("phonetic_keys_names")) == len(queries.NAMES)


@pytest.mark.parametrize("name", sorted(queries.SOUND_TABLE))
def test_sound_searches(spark, name):
    for r in queries.queries()[name](spark, SMALL).collect():
        assert r.score >= 0


def shuffled(spark):
    """Records that all stages so far have written for a shuffle."""
    sc, gateway = spark.sparkContext, spark.sparkContext._gateway
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    none = gateway.jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(k) for k in range(stages.size()))}


@pytest.mark.parametrize("name", ["phonetic_prefix_documents", "phonetic_soft_documents", "exact_in", "exact_in_all", "phonetic_close_documents", "near_documents"])
def test_search_shuffles_what_it_finds(spark, monkeypatch, name):
    """Not the postings of a table that is too large to be held; near and sound searches shuffle a vocabulary."""
    rows = queries.table(spark, SMALL, queries.DOCS)
    pairs = index.postings(rows).count()
    monkeypatch.setattr(index, "HELD", -1, raising=False)
    run = queries.queries()[name]
    spark.catalog.clearCache()
    before = shuffled(spark)
    found = sorted(map(tuple, run(spark, SMALL).collect()))
    written = sum(n for k, n in shuffled(spark).items() if k not in before)
    assert written < (pairs / 20 if name.startswith("exact") else pairs)
    monkeypatch.undo()
    assert found == sorted(map(tuple, run(spark, SMALL).collect()))
    spark.catalog.clearCache()


def test_lines_of_parts(spark):
    n = queries.table(spark, SMALL, queries.PARTS).where(F.trim("text") != "").count()
    assert queries.queries()["delimited_lenient_part"](spark, SMALL).count() == n
    assert len([r for r in queries.queries()["delimited_parse_part"](spark, SMALL).collect() if r.problem == ""]) == n
