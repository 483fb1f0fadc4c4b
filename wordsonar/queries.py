"""Registered queries: each operator over whole tables of the driver, or over a few names where no table has any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import distance, phonetic
from .model import Location, MatchMode, SearchRequest, SearchType
from .operators import combine, diagnostics, index, sets
from .plans.engine import Search
from .sources import records

#: Records of names, for sound search.
NAMES = list(enumerate(
    "Иванов|Иванова|Петров|Петрова|Папондопуло|Папандопуло|Егор|Игорь|Терентьев|Тирентев|Забабонова|Забабанова|Щербаков|Смирнов Пётр|Соловьёв|"
    "Салтыков-Щедрин|Анна Иванова|Алла|Дьяченко|Семёнов|Симинов|Харламов|Карламов|Smith".split("|"), 1
))
#: Names in Latin letters.
LATIN_NAMES = list(enumerate("Ivanov|Shcherbakov|Tchaikovsky|Dzhafarov|D'Yachenko|Kharlamov|Smith|Maximov|Petrova-Tsch|Jones".split("|")))
#: Lines of which some are bad.
LINES = ["1;red bolt", " 2 ; blue;nut ", "", "x;green gear", "3", "4;", ";5", "+6;old ring", "2147483648;big", "12.5;half", "   ", "-7;last"]

ALL, ANY, SOFT = MatchMode.ALL_TERMS, MatchMode.ANY_TERM, MatchMode.SOFT_ALL_TERMS
BEGIN, IN = Location.BEGIN_WORD, Location.IN_WORD

#: The tables that are searched: table, id, text.
DOCS, PARTS, TALK, CUSTOMERS = ("documents", "doc_id", "text"), ("part", "p_partkey", "p_name"), ("conversations", "conv_id", "text"), ("customer", "c_custkey", "c_name")

#: Exact searches: source, query, location, mode.
EXACT = {
    "exact_begin": (DOCS, "ention", BEGIN, ALL),
    "exact_in": (DOCS, "thanst", IN, ALL),
    "exact_all": (PARTS, "red widget", BEGIN, ALL),
    "exact_any": (PARTS, "red bolt", BEGIN, ANY),
    "exact_soft": (PARTS, "small red widget", BEGIN, SOFT),
    "exact_in_all": (DOCS, "thion onst ering", IN, ALL),
    "exact_in_soft": (DOCS, "schkeit ciónes aiment", IN, SOFT),
    "conversation_any": (TALK, "hean, reou!", BEGIN, ANY),
}
#: Near searches: source, query, location, mode, misprints, precision (-1: unset), union.
NEAR = {
    "near_begin_1": (PARTS, "bklt", BEGIN, ALL, 1, -1, False),
    "near_begin_2": (PARTS, "widgte", BEGIN, ALL, 2, -1, False),
    "near_in": (PARTS, "idger", IN, ALL, 2, -1, False),
    "near_precision": (PARTS, "widgwt", BEGIN, ALL, -1, 60, False),
    "near_default": (PARTS, "ring", BEGIN, ALL, -1, -1, False),
    "near_union": (PARTS, "bil", BEGIN, ALL, 3, -1, True),
    "near_two_letters": (PARTS, "bo", BEGIN, ALL, 2, -1, False),
    "near_all": (PARTS, "rde widgte", BEGIN, ALL, 2, -1, False),
    "near_any": (PARTS, "rde boly", BEGIN, ANY, 2, -1, False),
    "near_soft": (PARTS, "rde widgte smsll", BEGIN, SOFT, 2, -1, False),
    "near_documents": (DOCS, "thanr", BEGIN, ALL, 1, -1, True),
}
#: Sound searches over NAMES: query, mode.
SOUND = {"phonetic_find": ("Иванов Петров", ANY), "phonetic_prefix": ("Папандо", ANY), "phonetic_close": ("Тирентев", ALL), "phonetic_soft": ("Анна Иванова", SOFT)}
#: The same over the words of the table documents.
SOUND_TABLE = {"phonetic_find_documents": ("schein mention", ANY), "phonetic_prefix_documents": ("schtschei", ANY), "phonetic_close_documents": ("chemin", ALL), "phonetic_soft_documents": ("schein mention chemin", SOFT)}
BATCH = {"a": "red widget", "b": "small bolt gear", "c": "ring"}


def table(spark: SparkSession, sf_dir: str, source: tuple[str, str, str]) -> DataFrame:
    name, key, text = source
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(key, text)
    return records.spread(rows).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))


def names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NAMES, "id bigint, text string")


def _exact(source, query, location, mode):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Search(spark).prepare_index(table(spark, sf_dir, source)).find(query, SearchRequest(mode, SearchType.EXACT, location))

    return run


def _near(source, query, location, mode, misprints, precision, union):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Search(spark, bucket_merge="union" if union else "intersect").prepare_index(table(spark, sf_dir, source))
        engine.misprints, engine.precision = misprints, precision
        return engine.find(query, SearchRequest(mode, SearchType.NEAR, location))

    return run


def _sound(query, mode):
    return lambda spark, sf_dir: Search(spark, phonetic=True).prepare_index(names(spark)).find(query, SearchRequest(mode))


def _sound_table(query, mode):
    return lambda spark, sf_dir: Search(spark, phonetic=True).prepare_index(table(spark, sf_dir, DOCS)).find(query, SearchRequest(mode))


def index_postings(spark, sf_dir):
    return index.postings(table(spark, sf_dir, DOCS))


def index_term_stats(spark, sf_dir):
    return index.term_stats(index.postings(table(spark, sf_dir, DOCS)))


def index_lists(spark, sf_dir):
    return index.lists(index.postings(table(spark, sf_dir, PARTS))).select("term", sets.shown(F.col("ids")).alias("ids"))


def custom_delimiters(spark, sf_dir):
    return index.postings(table(spark, sf_dir, PARTS), delimiters="ei ")


def number_search(spark, sf_dir):
    engine = Search(spark)
    engine.is_number_search = True
    return engine.prepare_index(table(spark, sf_dir, CUSTOMERS)).find("customer#00000001")


def no_number_search(spark, sf_dir):
    """Words with digits aren't indexed; a record keeps its other words."""
    rows = table(spark, sf_dir, CUSTOMERS).select("id", F.concat(F.lit("Name "), "text").alias("text"))
    return index.term_stats(index.postings(rows))


def delimited_source(spark, sf_dir):
    rows = table(spark, sf_dir, PARTS).select(F.concat_ws(";", F.col("id").cast("string"), "text").alias("line"))
    return Search(spark).prepare_index_from_lines(rows, ";", id_kind="long").find("red")


def delimited_parse(spark, sf_dir):
    parsed = records.parse_lines(records.lines_of(spark, LINES), ";", "int")
    return parsed.select("line_no", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("id", "text", "problem")])


def delimited_lenient(spark, sf_dir):
    return records.from_lines(records.lines_of(spark, LINES), ";", "int", lenient=True)


def keyboard_distance(spark, sf_dir):
    terms = index.vocabulary(index.postings(table(spark, sf_dir, PARTS))).where("len = 6")
    return terms.select("term", distance.keyboard_distance("WIDGTE", F.col("term")).alias("d"))


def keyboard_distance_all(spark, sf_dir):
    """To every distinct word of the whole table, of any length."""
    terms = index.vocabulary(index.postings(table(spark, sf_dir, PARTS)))
    return terms.select("term", distance.keyboard_distance("WIDGTE", F.col("term")).alias("d"))


def phonetic_keys(spark, sf_dir):
    key = lambda approx: phonetic.first_key(F.col("text"), approx)
    return names(spark).where("id not in (14, 17)").select("id", phonetic.language(F.col("text")).alias("language"), key(False).alias("strict"), key(True).alias("approx"))


def phonetic_index(spark, sf_dir):
    return index.phonetic_postings(index.postings(names(spark)))


def phonetic_latin(spark, sf_dir):
    found = spark.createDataFrame(LATIN_NAMES, "id bigint, text string")
    return found.select("id", phonetic.language(F.col("text")).alias("language"), phonetic.transliterated("text").alias("cyrillic"), phonetic.first_key(F.col("text")).alias("approx"))


def _metaphone(rows):
    return index.vocabulary(index.postings(rows)).select("term", phonetic.metaphone_key("term").alias("key"))


def metaphone(spark, sf_dir):
    return _metaphone(table(spark, sf_dir, PARTS))


def metaphone_names(spark, sf_dir):
    """Of words in either alphabet."""
    return _metaphone(spark.createDataFrame(NAMES + LATIN_NAMES, "id bigint, text string"))


def metaphone_documents(spark, sf_dir):
    return _metaphone(table(spark, sf_dir, DOCS))


def deletion_index(spark, sf_dir):
    return index.deletions(index.vocabulary(index.postings(table(spark, sf_dir, PARTS))))


def _named(spark):
    return names(spark).select(F.col("text").alias("name"))


def key_distribution(spark, sf_dir):
    return diagnostics.key_distribution(_named(spark), phonetic.keys(F.col("name")))


def largest_buckets(spark, sf_dir):
    """A report of the top 15, as the operator has it."""
    found = diagnostics.largest_buckets(diagnostics.key_buckets(_named(spark), phonetic.keys(F.col("name"))))
    return found.select("key", "n", F.array_join("names", ",").alias("names"))


# Sound operators over whole tables; SQL has no encoder for them, tests hold them against the plain functions.


def _words(spark, sf_dir):
    return index.vocabulary(index.postings(table(spark, sf_dir, DOCS))).select(F.col("term").alias("name"))


def phonetic_keys_names(spark, sf_dir):
    """All names, those with a space too."""
    return names(spark).select("id", phonetic.language(F.col("text")).alias("language"), phonetic.first_key(F.col("text"), False).alias("strict"), phonetic.first_key(F.col("text")).alias("approx"))


def phonetic_keys_documents(spark, sf_dir):
    name = F.col("name")
    return _words(spark, sf_dir).select(
        F.col("name").alias("term"), phonetic.language(name).alias("language"), phonetic.transliterated(name).alias("cyrillic"),
        phonetic.first_key(name, False).alias("strict"), phonetic.first_key(name).alias("approx"),
    )


def phonetic_index_documents(spark, sf_dir):
    return index.phonetic_postings(index.tokens(table(spark, sf_dir, DOCS)))


def key_distribution_documents(spark, sf_dir):
    return diagnostics.key_distribution(_words(spark, sf_dir), phonetic.keys(F.col("name")))


def largest_buckets_documents(spark, sf_dir):
    """A report of the top 15, as the operator has it."""
    found = diagnostics.largest_buckets(diagnostics.key_buckets(_words(spark, sf_dir), phonetic.keys(F.col("name"))))
    return found.select("key", "n", F.array_join("names", ",").alias("names"))


def _part_lines(spark, sf_dir):
    rows = table(spark, sf_dir, PARTS).select(F.concat_ws(";", F.col("id").cast("string"), "text").alias("line"))
    return records.numbered(rows)


def delimited_parse_part(spark, sf_dir):
    parsed = records.parse_lines(_part_lines(spark, sf_dir), ";", "long")
    return parsed.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("id", "text", "problem")])


def delimited_lenient_part(spark, sf_dir):
    return records.from_lines(_part_lines(spark, sf_dir), ";", "long", lenient=True)


def _of(spark, sf_dir, *terms):
    posts = index.postings(table(spark, sf_dir, PARTS))
    return [posts.where(F.col("term") == t).select("id") for t in terms]


def set_union(spark, sf_dir):
    return sets.union(*_of(spark, sf_dir, "RED", "BOLT", "RING"))


def set_intersect(spark, sf_dir):
    return sets.intersection(*_of(spark, sf_dir, "RED", "BOLT"))


def set_missing(spark, sf_dir):
    return sets.missing_counts(*_of(spark, sf_dir, "RED", "BOLT", "SMALL"))


def set_arrays(spark, sf_dir):
    lists = index.lists(index.postings(table(spark, sf_dir, PARTS)))
    pair = lists.where("term = 'RED'").select(F.col("ids").alias("a")).crossJoin(lists.where("term = 'BOLT'").select(F.col("ids").alias("b")))  # one row each
    a, b = F.col("a"), F.col("b")
    none = F.array().cast("array<bigint>")
    return pair.select(
        sets.shown(sets.narrow(a, b)).alias("narrowed"), sets.shown(sets.narrow(none, b)).alias("taken"), sets.shown(sets.narrow_to_any(a, F.array(b, a))).alias("to_any"),
        sets.shown(sets.added(a, F.lit(-1).cast("bigint"))).alias("added"), sets.overlaps(a, b).alias("overlaps"),
    )


def bucketised(spark, sf_dir):
    found = Search(spark).prepare_index(table(spark, sf_dir, PARTS)).find("small red widget", SearchRequest(SOFT))
    return combine.buckets(found).select("score", sets.shown(F.col("ids")).alias("ids"))


def find_batch(spark, sf_dir):
    return Search(spark).prepare_index(table(spark, sf_dir, PARTS)).find_batch(BATCH, SearchRequest(SOFT))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (
        index_postings, index_term_stats, index_lists, custom_delimiters, number_search, no_number_search, delimited_source, delimited_parse, delimited_lenient, keyboard_distance,
        phonetic_keys, phonetic_index, phonetic_latin, metaphone, metaphone_names, metaphone_documents, deletion_index, key_distribution, largest_buckets,
        set_union, set_intersect, set_missing, set_arrays, bucketised, find_batch,
        phonetic_keys_names, phonetic_keys_documents, phonetic_index_documents, key_distribution_documents, largest_buckets_documents, delimited_parse_part, delimited_lenient_part,
        keyboard_distance_all,
    )
    found = {name: _exact(*x) for name, x in EXACT.items()}
    found |= {name: _near(*x) for name, x in NEAR.items()}
    found |= {name: _sound(*x) for name, x in SOUND.items()}
    found |= {name: _sound_table(*x) for name, x in SOUND_TABLE.items()}
    return found | {f.__name__: f for f in plain}
