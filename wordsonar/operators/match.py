"""Terms of queries against an index: which ids match which term, at which distance.

Terms come as literals (the driver has the queries), so an exact search is one filtered scan of the index's rows and a near
search one pass over the vocabulary, however many terms are asked for. The words that it finds go to the rows, so no search
shuffles the rows that it doesn't find. Results are rows (q, id, d).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distance import near_matcher, phonetic_matcher
from ..model import Location, Options, SearchType
from .index import Index, deletion_key

#: From this length on a sound key is also matched as a beginning.
PREFIX = 7
_SCHEMA = "q string, key string, d int"
#: Bytes of found words that are sent to the rows, at most; for more than that both meet by a shuffle.
SENT = 4 << 20


def _holds(term: Column, q: str, location: Location) -> Column:
    return F.startswith(term, F.lit(q)) if location == Location.BEGIN_WORD else F.contains(term, F.lit(q))


def exact(index: Index, terms: list[str], location: Location) -> DataFrame:
    """(q, id, d = 0) of rows whose term begins with (or holds) a query term; one scan, the filter goes to it."""
    term = F.col("term")
    wanted = reduce(lambda a, b: a | b, [_holds(term, q, location) for q in terms])
    hits = F.filter(F.array(*[F.when(_holds(term, q, location), F.lit(q)) for q in terms]), lambda q: q.isNotNull())
    found = index.rows.where(wanted).select(F.explode(hits).alias("q"), "id")
    return found.distinct().select("q", "id", F.lit(0).alias("d"))


def with_ids(index: Index, words: DataFrame) -> DataFrame:
    """(key, q, d, id) of the rows that have one of the found words (q, key, d), which are held; pairs repeat as rows do."""
    words = index.hold(words)
    n, size = words.agg(F.count("*"), F.sum(F.octet_length("key"))).first()
    few = (size or 0) + 64 * n <= SENT
    return index.rows.withColumnRenamed("term", "key").join(F.broadcast(words) if few else words, "key").select("key", "q", "d", "id")


def near(index: Index, wanted: list[tuple[str, Location, int]], union: bool = False) -> DataFrame:
    """(q, id, d) of a near search with the bound of each term.

    Of one term and distance, an id counts only if every key at that distance has it (union: if any has).
    """
    least = min(len(q) for q, _, _ in wanted)
    match = near_matcher([(q, location == Location.IN_WORD, most) for q, location, most in wanted])
    keys = index.vocab.where(F.col("len") >= least).select("term").mapInPandas(match, _SCHEMA)
    found = with_ids(index, keys)
    if union:
        return found.select("q", "id", "d").distinct()
    if index.rows is not index.posts:
        found = found.distinct()
    need = keys.groupBy("q", "d").agg(F.count("*").alias("need"))
    held = found.groupBy("q", "d", "id").agg(F.count("*").alias("n"))
    # a row for each query term and distance: as many as the query has
    return held.join(F.broadcast(need), ["q", "d"]).where("n = need").select("q", "id", "d")


def phonetic_candidates(index: Index, terms: list[str]) -> DataFrame:
    """(q, key): keys that begin with a long query key, or share one deletion with it, and aren't shorter than it."""
    parts = []
    lookups = sorted({(v, q) for q in terms for v in {q, *(deletion_key(q, i) for i in range(len(q)))}})
    spark = index.posts.sparkSession
    # some dozens of rows: a query's own deletions
    asked = spark.createDataFrame(lookups, "variant string, q string")
    shared = index.deletions.where(F.col("variant").isin([v for v, _ in lookups])).join(F.broadcast(asked), "variant")
    parts.append(shared.select("q", "key"))
    for q in terms:
        if len(q) >= PREFIX:
            parts.append(index.vocab.where(F.startswith("term", F.lit(q))).select(F.lit(q).alias("q"), F.col("term").alias("key")))
    return reduce(DataFrame.union, parts).where("length(key) >= length(q)").distinct()


def phonetic(index: Index, terms: list[str], candidates: bool = True) -> DataFrame:
    """(q, id, d) with d 0 or 1; without candidates all keys are compared, whatever their length."""
    if candidates:
        pairs = phonetic_candidates(index, terms)
    else:
        pairs = index.vocab.select(F.explode(F.array(*map(F.lit, terms))).alias("q"), F.col("term").alias("key"))
    keys = pairs.mapInPandas(phonetic_matcher(terms), _SCHEMA)
    if index.coded is not None:  # the words that have these keys
        keys = keys.join(index.coded.select("term", "key"), "key").groupBy("q", F.col("term").alias("key")).agg(F.min("d").alias("d"))
    return with_ids(index, keys).groupBy("q", "id").agg(F.min("d").alias("d"))


def matches(index: Index, terms: list[str], options: Options, union: bool = False, candidates: bool = True) -> DataFrame:
    """(q, id, d): the plan for each term by the options; a near search of a term of two characters, or one that
    allows no distance, is an exact one."""
    if index.phonetic:
        return phonetic(index, terms, candidates)
    if options.search_type == SearchType.EXACT:
        return exact(index, terms, options.location)
    plain = [q for q in terms if len(q) == 2 or options.allowed(len(q)) == 0]
    fuzzy = [(q, options.location, options.allowed(len(q))) for q in terms if q not in plain]
    parts = [exact(index, plain, options.location)] if plain else []
    parts += [near(index, fuzzy, union)] if fuzzy else []
    return reduce(DataFrame.union, parts)
