"""Matches of a query's terms to scored ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import MatchMode


def combine(matches: DataFrame, queries: dict[str, list[str]], mode: MatchMode) -> DataFrame:
    """(query_id, score, id) of (q, id, d), for queries by id with their distinct terms.

    An id's best distance to each of its query's terms is one column, so one shuffle (with sums before it) serves any
    number of terms. All terms: the sum of distances where every term matches; any: the least distance; soft: the sum,
    and for each missing term a penalty one greater than the query's greatest sum. A query of one term has its
    distances as scores, whatever the mode.
    """
    slots = max(map(len, queries.values()))
    asked = [(name, q, k, len(terms)) for name, terms in queries.items() for k, q in enumerate(terms)]
    if len(queries) == 1:
        name, terms = next(iter(queries.items()))
        slot = F.coalesce(*[F.when(F.col("q") == q, k) for k, q in enumerate(terms)])
        rows = matches.select(F.lit(name).alias("query_id"), F.lit(len(terms)).alias("terms"), slot.alias("slot"), "id", "d")
    else:
        # the queries themselves: a row for each of their terms, held by the driver already
        named = matches.sparkSession.createDataFrame(asked, "query_id string, q string, slot int, terms int")
        rows = matches.join(F.broadcast(named), "q")
    best = rows.groupBy("query_id", "terms", "id").agg(*[F.min(F.when(F.col("slot") == k, F.col("d"))).alias(f"d{k}") for k in range(slots)])
    each = [F.col(f"d{k}") for k in range(slots)]
    matched = reduce(lambda a, b: a + b, [F.when(d.isNull(), 0).otherwise(1) for d in each])
    total = reduce(lambda a, b: a + b, [F.coalesce(d, F.lit(0)) for d in each])
    least = F.least(*each) if slots > 1 else each[0]
    if mode == MatchMode.ANY_TERM:
        found = best.select("query_id", least.alias("score"), "id")
    elif mode == MatchMode.ALL_TERMS:
        found = best.where(matched == F.col("terms")).select("query_id", total.alias("score"), "id")
    else:
        sums = best.select("query_id", "terms", "id", matched.alias("matched"), total.alias("total"))
        # a row for each query
        worst = sums.groupBy("query_id").agg((F.max("total") + 1).alias("penalty"))
        score = F.col("total") + F.when(F.col("terms") > 1, (F.col("terms") - F.col("matched")) * F.col("penalty")).otherwise(0)
        found = sums.join(F.broadcast(worst), "query_id").select("query_id", score.alias("score"), "id")
    return found.select("query_id", F.col("score").cast("int").alias("score"), "id")


def buckets(scored: DataFrame) -> DataFrame:
    """(score, ids): ids ascending, for presentation."""
    return scored.groupBy("score").agg(F.sort_array(F.collect_list("id")).alias("ids"))
