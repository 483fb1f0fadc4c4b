import uuid

import pytest
from pyspark.sql import functions as F

from wordsonar import ErrorCode, Location, MatchMode, Search, SearchError, SearchRequest, SearchType
from wordsonar.operators import diagnostics, index, sets
from wordsonar.plans import policy
from wordsonar.sources import records

NEAR, BEGIN, IN = SearchType.NEAR, Location.BEGIN_WORD, Location.IN_WORD
ALL, ANY, SOFT = MatchMode.ALL_TERMS, MatchMode.ANY_TERM, MatchMode.SOFT_ALL_TERMS
ENGLISH = ["Check the process", "Process is ready", "Process simple work", "Thread number is 123AB", "The date is 19.09.2023"]
GREEK = ["альфа бета гамма", "альфа бета", "бета гамма", "альфа", "дельта"]


def table(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts, 1)], "id int, text string")


def built(spark, texts, **options):
    return Search(spark, **options).prepare_index(table(spark, texts))


def test_vocabulary(spark):
    engine = built(spark, ENGLISH)
    assert {r.term for r in engine.index.vocab.collect()} == set("CHECK THE PROCESS IS READY SIMPLE WORK THREAD NUMBER DATE".split())
    lines = Search(spark).prepare_index_from_lines([f"{k};{t}" for k, t in enumerate(ENGLISH)], ";")
    assert lines.index.vocab.count() == 10
    assert built(spark, ENGLISH).prepare_index(table(spark, ENGLISH), partitions=3).index.posts.count() == engine.index.posts.count()


@pytest.mark.parametrize("mode,found", [(ALL, {0: [1]}), (ANY, {0: [1, 2, 3, 4]}), (SOFT, {0: [1], 1: [2, 3], 2: [4]})])
def test_modes(spark, mode, found):
    assert built(spark, GREEK).find_buckets("альфа бета гамма", SearchRequest(mode)) == found


@pytest.mark.parametrize("mode", [ALL, ANY, SOFT])
def test_one_term_ignores_mode(spark, mode):
    assert built(spark, ["договор", "договор поставки", "акт"]).find_buckets("договор", SearchRequest(mode)) == {0: [1, 2]}


def test_best_bucket(spark):
    assert built(spark, ["договор договра"]).find_buckets("договор", SearchRequest(search_type=NEAR, misprints=1)) == {0: [1]}


def test_missing_bucket(spark):
    found = built(spark, ["альфа"]).find_buckets("альфа")
    assert found[0] == [1] and found[7] == () and found.has_any and list(found) == [0]
    assert not built(spark, ["альфа"]).find_buckets("омега").has_any


def test_substring(spark):
    assert built(spark, ["ultraprocessormodule"]).find_buckets("process", SearchRequest(search_type=NEAR, location=IN, misprints=0)) == {0: [1]}


def test_near_buckets(spark):
    texts = ["коты", "кота", "кот", "код"]
    request = SearchRequest(search_type=NEAR, misprints=2)
    assert built(spark, texts).find_buckets("кот", request) == {2: [4]}
    assert built(spark, texts, bucket_merge="union").find_buckets("кот", request) == {0: [1, 2, 3], 2: [4]}


def test_near_modes(spark):
    engine = built(spark, ["red widget", "red", "wudget", "green"], bucket_merge="union")
    request = lambda mode: SearchRequest(mode, NEAR, misprints=2)
    assert engine.find_buckets("red widget", request(ALL)) == {0: [1]}
    assert engine.find_buckets("red widget", request(ANY))[0] == [1, 2]
    soft = engine.find_buckets("red widget", request(SOFT))
    assert list(soft.items())[0] == (0, [1]) and {i for ids in soft.values() for i in ids} == {1, 2, 3}


def test_settings(spark):
    engine = Search(spark)
    engine.precision, engine.misprints = 101, -2
    assert (engine.precision, engine.misprints) == (-1, -1)
    engine.precision, engine.misprints, engine.is_number_search = 40, 2, True
    assert (engine.precision, engine.misprints, engine.is_number_search) == (40, 2, True)
    sound = Search(spark, phonetic=True)
    sound.is_number_search = True
    assert not sound.is_number_search
    engine = built(spark, ["красный"])
    engine.find("красный", SearchRequest(search_type=NEAR, location=IN, misprints=1))
    assert (engine.search_type, engine.location, engine.misprints) == (SearchType.EXACT, BEGIN, -1)
    assert engine.find("красны", SearchRequest(search_type=NEAR, precision=100)).count() == 1


def test_events(spark):
    engine, seen = Search(spark), []
    engine.on_index_complete.append(seen.append)
    engine.prepare_index(table(spark, ["слово"]))
    assert seen == [False, True]


def failed(call) -> ErrorCode:
    with pytest.raises(SearchError) as e:
        call()
    return e.value.code


def test_errors(spark):
    engine = built(spark, ["слово"])
    empty = spark.createDataFrame([], "id int, text string")
    assert failed(lambda: engine.prepare_index(empty)) == ErrorCode.INVALID_SOURCE_RECORD
    assert engine.find("слово").count() == 1  # the former index stays
    assert failed(lambda: engine.find(" ")) == failed(lambda: engine.find("")) == ErrorCode.EMPTY_QUERY
    assert failed(lambda: Search(spark).find("слово")) == ErrorCode.INDEX_NOT_BUILT
    assert failed(lambda: built(spark, ["1", "a"]).find("слово")) == ErrorCode.INDEX_IS_EMPTY
    assert failed(lambda: engine.find("a - b")) == ErrorCode.QUERY_HAS_NO_SEARCHABLE_TERMS
    for request in (SearchRequest(999), SearchRequest(search_type=7), SearchRequest(location=5), SearchRequest(precision=101), SearchRequest(misprints=-1)):
        assert failed(lambda request=request: engine.find("слово", request)) == ErrorCode.INVALID_SEARCH_REQUEST
    assert failed(lambda: engine.prepare_index(spark.createDataFrame([(1, None)], "id int, text string"))) == ErrorCode.INDEX_BUILD_FAILED


@pytest.mark.parametrize(
    "lines,delimiter,code,message",
    [
        ([], ";", ErrorCode.INVALID_SOURCE_RECORD, ""), (["1;x"], "", ErrorCode.INVALID_DELIMITED_SOURCE_FORMAT, ""), (["1 Check"], ";", ErrorCode.INVALID_DELIMITED_SOURCE_FORMAT, "Line 1"),
        (["1;ok", "abc;Check"], ";", ErrorCode.INVALID_ID_FORMAT, "Line 2"), (["1;"], ";", ErrorCode.INVALID_DELIMITED_SOURCE_FORMAT, "Line 1"), ([""], ";", ErrorCode.INVALID_SOURCE_RECORD, "Line 1"),
        ([";x"], ";", ErrorCode.INVALID_DELIMITED_SOURCE_FORMAT, "Line 1"), (["12.5;x"], ";", ErrorCode.INVALID_ID_FORMAT, "Line 1"),
    ],
)
def test_bad_lines(spark, lines, delimiter, code, message):
    with pytest.raises(SearchError) as e:
        Search(spark).prepare_index_from_lines(lines, delimiter)
    assert e.value.code == code and e.value.message.startswith(message)


def test_lines(spark, tmp_path):
    engine = Search(spark).prepare_index_from_lines(["1;товар;с дополнительным;разделителем"], ";")
    assert engine.find_buckets("разделителем") == {0: [1]}
    assert Search(spark).prepare_index_from_lines(["1;слово", "дурно", "2;слово"], ";", lenient=True).find_buckets("слово") == {0: [1, 2]}
    (tmp_path / "a.txt").write_text("1|один\n2|два\nx|три\n")
    with pytest.raises(SearchError, match="Line 3"):
        Search(spark).prepare_index_from_lines(spark.read.text(str(tmp_path)), "|")


@pytest.mark.parametrize(
    "kind,good,bad",
    [
        ("byte", [" 5 ", "255", "+7"], ["256", "-1"]), ("short", ["-32768"], ["32768"]), ("ushort", ["65535"], ["65536"]), ("int", ["0002147483647"], ["2147483648", "1e3", ""]), ("uint", ["4294967295"], ["-5"]),
        ("long", ["-9223372036854775808"], ["9223372036854775808"]), ("ulong", ["18446744073709551615"], ["18446744073709551616"]),
        ("guid", [str(uuid.UUID(int=5)), "{" + str(uuid.UUID(int=6)).upper() + "}", uuid.UUID(int=7).hex], ["1234", "{" + uuid.UUID(int=7).hex + "}"]), ("date", [], ["2020-01-01"]),
    ],
)
def test_ids(spark, kind, good, bad):
    rows = spark.createDataFrame([(x,) for x in good + bad], "x string").select("x", records.parse_id(F.col("x"), kind).alias("id")).collect()
    assert [r.id is not None for r in rows] == [True] * len(good) + [False] * len(bad)
    if kind == "guid":
        assert rows[1].id == str(uuid.UUID(int=6))
    elif good:
        assert [int(r.id) for r in rows[: len(good)]] == [int(x) for x in good]


def test_spread(spark, tmp_path, monkeypatch):
    rows = spark.range(1000).selectExpr("id", "uuid() AS text").coalesce(1)
    rows.write.parquet(str(tmp_path / "one"))
    rows.repartition(3).write.parquet(str(tmp_path / "three"))
    one, three = spark.read.parquet(str(tmp_path / "one")), spark.read.parquet(str(tmp_path / "three"))
    assert records.spread(one) is one  # too small to be worth it
    monkeypatch.setattr(records, "SMALL_FILE", (1, 1 << 30))
    assert records.spread(one).select(F.spark_partition_id()).distinct().count() == spark.sparkContext.defaultParallelism and records.spread(three) is three
    assert records.spread(one).exceptAll(one).isEmpty() and records.spread(one).count() == 1000
    monkeypatch.setattr(records, "SMALL_FILE", (1, 10))
    assert records.spread(one) is one


def test_word_list(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# note\nbeta\n\n Alpha \nalpha\n")
    (tmp_path / "b.txt").write_text("BETA\ngamma\n")
    assert [r.word for r in records.word_list(spark, str(tmp_path)).collect()] == ["Alpha", "BETA", "gamma"]


MATRIX = [
    ("Егор", ["Егор", "Игорь"], ["Петров"]), ("Терентьев", ["Терентьев", "Тирентев"], ["Петров"]), ("Папондопуло", ["Папондопуло", "Папандопуло"], ["Петров"]),
    ("Забабонова", ["Забабонова", "Забабанова"], ["Петров"]), ("Папандо", ["Папандопуло"], ["Петров", "Смирнов"]), ("Папанд", [], ["Папандопуло"]), ("Ivanov", ["Иванов"], ["Петров"]), ("Иванов", ["Иванова"], []),
]


@pytest.fixture(scope="module")
def sound(spark):
    names = sorted({n for _, a, b in MATRIX for n in a + b})
    return names, built(spark, names, phonetic=True)


@pytest.mark.parametrize("query,expected,forbidden", MATRIX)
def test_sound(sound, query, expected, forbidden):
    names, engine = sound
    found = {names[r.id - 1] for r in engine.find(query, SearchRequest(ANY)).collect()}
    assert found >= set(expected) and not found & set(forbidden)


def test_sound_without_candidates(spark):
    engine = built(spark, ["абвг"], phonetic=True, encoder=lambda w: w)
    assert [(r.score, r.id) for r in engine.find("абвж", candidates=False).collect()] == [(1, 1)] or engine.find("абвж", candidates=False).count() == 0
    assert built(spark, ["ABD"], encoder=lambda w: w).find_buckets("ABC") == {1: [1]}


def test_encoder_with_several_keys(spark):
    keys = {"ПЕРВЫЙ": ["ONE"], "ВТОРОЙ": ["TWO"], "ОБА": ["ONE", "TWO", "ONE", " "], "ЛИШНИЙ": ["THREE"]}
    engine = built(spark, ["Первый", "Второй", "Оба", "Лишний"], encoder=keys.get)
    assert {r.id for r in engine.find("Оба", SearchRequest(ANY)).collect()} == {1, 2, 3}
    assert {r.id for r in engine.find("Оба", SearchRequest(ALL)).collect()} == {3}


def test_batch(spark):
    engine = built(spark, GREEK)
    rows = engine.find_batch({"a": "альфа", "b": "бета гамма"}, SearchRequest(SOFT)).collect()
    for name, query in (("a", "альфа"), ("b", "бета гамма")):
        assert sorted((r.score, r.id) for r in rows if r.query_id == name) == sorted(map(tuple, engine.find(query, SearchRequest(SOFT)).collect()))


def test_save_and_load(spark, tmp_path):
    built(spark, ["Иванов", "Петров"], phonetic=True).index.save(str(tmp_path))
    assert Search(spark).use(index.Index.load(spark, str(tmp_path), phonetic=True)).find_buckets("Иванов") == {0: [1]}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, tmp_path):
    """A saved index is asked for word beginnings by pushed filters; combination is one aggregation by id."""
    built(spark, GREEK).index.save(str(tmp_path))
    engine = Search(spark).use(index.Index.load(spark, str(tmp_path)))
    plan = plan_of(engine.find("альфа бета", SearchRequest(ANY)))
    assert "StringStartsWith(term,АЛЬФА)" in plan and "StringStartsWith(term,БЕТА)" in plan
    assert plan.count("FileScan") == 1 and "Join" not in plan and "Python" not in plan and "Pandas" not in plan
    near = plan_of(engine.find("альфа", SearchRequest(search_type=NEAR, misprints=2)))
    assert near.count("MapInPandas") >= 1 and "CartesianProduct" not in near and "NestedLoop" not in near


def test_deletions(spark):
    found = index.deletions(spark.createDataFrame([("ABA",), ("A",)], "term string")).collect()
    assert sorted(tuple(r) for r in found) == [("", "A"), ("A", "A"), ("AA", "ABA"), ("AB", "ABA"), ("ABA", "ABA"), ("BA", "ABA")]
    assert [index.deletion_key("ABC", 1), index.deletion_key("A", 0), index.deletion_key("", 0)] == ["AC", "", ""]


def test_sets(spark):
    a, b, c = (spark.createDataFrame([(x,) for x in ids], "id int") for ids in ([1, 2, 3], [2, 3, 4], [3, 5]))
    assert sorted(r.id for r in sets.union(a, b, c).collect()) == [1, 2, 3, 4, 5] and [r.id for r in sets.intersection(a, b, c).collect()] == [3]
    assert {r.id: r.missing for r in sets.missing_counts(a, b).collect()} == {1: 1, 2: 0, 3: 0, 4: 1}
    df = spark.createDataFrame([([1, 2, 3], [3, 2, 9]), ([], [5, 4, 5])], "a array<int>, b array<int>")
    x, y = F.col("a"), F.col("b")
    rows = df.select(sets.narrow(x, y), sets.narrow_to_any(x, F.array(y, F.array(F.lit(1)))), sets.added(x, F.lit(2)), sets.overlaps(x, y), sets.shown(y)).collect()
    assert [list(r) for r in rows] == [[[2, 3], [1, 2, 3], [1, 2, 3], True, "2,3,9"], [[4, 5], [1, 4, 5], [2], False, "4,5,5"]]


def test_policy():
    assert [policy.degree_of_parallelism(n) for n in (1, 2, 4, 8, 16)] == [1, 2, 3, 6, 12]
    assert not policy.should_use_parallel(1, True, 10) and policy.should_use_parallel(2, True, 0) and not policy.should_use_parallel(8, False, 10**6) and policy.should_use_parallel(8, False, 11, 10)


def test_diagnostics(spark):
    names = spark.createDataFrame([("x1",), ("x2",), ("y1",), ("",)], "name string")
    keys = F.when(F.col("name") == "", F.array().cast("array<string>")).otherwise(F.array(F.substring("name", 1, 1)))
    row = diagnostics.key_distribution(names, keys).first().asDict()
    assert row == {"source": 4, "encoded": 3, "skipped": 1, "unique_keys": 2, "links": 3, "avg_bucket": 1.5, "max_bucket": 2, "over_1": 1, "over_5": 0, "over_10": 0, "ratio": 0.5}
    assert [tuple(r) for r in diagnostics.largest_buckets(diagnostics.key_buckets(names, keys), 1).collect()] == [("x", 2, ["x1", "x2"])]
    assert diagnostics.key_distribution(names.limit(0), keys).first().ratio == 0


def test_stream(spark, tmp_path):
    from wordsonar.streaming import increment

    source = tmp_path / "in"
    for k, texts in enumerate((["красный шар"], ["красный куб"])):
        table(spark, texts).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("id int, text string").option("maxFilesPerTrigger", 1).parquet(str(source))
    increment.grow(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r.term for r in increment.current(spark, str(tmp_path / "out")).collect()) == ["КРАСНЫЙ", "КУБ", "ШАР"]


def test_many_lists(spark):
    lists = [spark.range(k % 3, 10).select(F.col("id")) for k in range(130)]
    assert sorted(r.id for r in sets.intersection(*lists).collect()) == list(range(2, 10))
    missing = {r.id: r.missing for r in sets.missing_counts(*lists).collect()}
    assert missing == {0: 86, 1: 43} | {k: 0 for k in range(2, 10)}


def test_results_and_lists(spark):
    a, b = spark.createDataFrame([(0, 1), (1, 2)], "score int, id int"), spark.createDataFrame([(1, 2), (1, 3), (2, 1)], "score int, id int")
    assert sorted(tuple(r) for r in sets.merged(a, b).collect()) == [(0, 1), (1, 2), (1, 3), (2, 1)]
    assert sets.equal(a, a.union(a)) and not sets.equal(a, b) and sets.equal(a.limit(0), b.limit(0))
    both = spark.createDataFrame([([1, 2], [1, 2]), ([1], [2]), (None, [1]), (None, None)], "a array<int>, b array<int>")
    assert [r[0] for r in both.select(sets.same(F.col("a"), F.col("b"))).collect()] == [True, False, False, True]
    x, y = spark.createDataFrame([("p", 1), ("q", 2)], "key string, v int"), spark.createDataFrame([("q", 3), ("r", 4)], "key string, v int")
    assert sorted(tuple(r) for r in sets.right_biased(x, y).collect()) == [("p", 1), ("q", 3), ("r", 4)]


def test_build_options_and_events(spark):
    rows = spark.createDataFrame([(k, f"word{'abcdefgh'[k % 8]}x red") for k in range(20)], "id int, text string").coalesce(1)
    made = []
    for options in ({}, {"force_parallel": True}, {"threshold": 5}, {"threshold": 50}):
        engine = Search(spark)
        engine.on_index_created.append(made.append)
        assert engine.prepare_index(rows, **options).find("red").count() == 20
    assert len(made) == 4
    with pytest.raises(ValueError):
        Search(None)


def test_near_measures_once(spark, monkeypatch):
    from wordsonar.operators import match

    seen, matcher = spark.sparkContext.accumulator(0), match.near_matcher

    def counted(wanted):
        run = matcher(wanted)

        def each(batches):
            for batch in batches:
                seen.add(len(batch))
                yield from run([batch])

        return each

    monkeypatch.setattr(match, "near_matcher", counted)
    engine = Search(spark).prepare_index(spark.createDataFrame([(1, "red"), (2, "rad bed"), (3, "blue")], "id int, text string"))
    found = engine.find("red", SearchRequest(search_type=SearchType.NEAR, misprints=2))
    assert found.count() > 0 and seen.value == 4
    engine.index.unpersist()


def test_rows_in_place_of_postings(spark, monkeypatch):
    """Without held postings a search gives the same; pairs that repeat, ids that repeat and several keys of a word too."""
    texts = ["red rad red", "rad bed", "red bed rod", "blue", "Схин Шин схин", "Шина", "шин"]
    rows = spark.createDataFrame([*enumerate(texts), (2, "red bed"), (3, "bed red")], "id int, text string")
    several = {"RED": ["ONE", "TWO"], "RAD": ["TWO"], "BED": ["ONES", "TWO", " "], "BLUE": []}
    requests = [("red bed", SearchRequest(m, t, loc, misprints=2)) for m in MatchMode for t in SearchType for loc in Location]

    def results():
        made = []
        for options in ({}, {"bucket_merge": "union"}, {"phonetic": True}, {"encoder": several.get}):
            engine = Search(spark, **options).prepare_index(rows)
            asked = [("шин", SearchRequest(m)) for m in MatchMode] if "phonetic" in options else [("red bed", SearchRequest(m)) for m in MatchMode] if "encoder" in options else requests
            made += [sorted(map(tuple, engine.find(q, r, candidates).collect())) for q, r in asked for candidates in ({True, "encoder" not in options})]
            made.append((engine.index.posts.count(), engine.index.vocab.count(), engine.index.is_empty()))
            engine.index.unpersist()
        return made

    held = results()
    monkeypatch.setattr(index, "HELD", -1)
    assert results() == held and all(held)
    monkeypatch.setattr("wordsonar.operators.match.SENT", -1)  # found words too many to be sent
    assert results() == held
    bad = spark.createDataFrame([("1", "red"), ("x", "шин")], "id string, text string").select(F.col("id").cast("int"), "text")
    for options in ({}, {"phonetic": True}, {"encoder": lambda w: 1 / 0}):
        assert failed(lambda options=options: Search(spark, **options).prepare_index(bad)) == ErrorCode.INDEX_BUILD_FAILED
        assert failed(lambda options=options: built(spark, ["1", "a"], **options).find("слово")) in (ErrorCode.INDEX_IS_EMPTY, ErrorCode.INDEX_BUILD_FAILED)
    engine = Search(spark).prepare_index(rows)
    assert engine.index.rows is not engine.index.posts and engine.index.cache().rows is engine.index.posts and engine.find("red").count() == 3
    engine.index.unpersist()
