"""Set operations on posting lists, as rows and as sorted arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union(*lists: DataFrame) -> DataFrame:
    """The distinct ids of all lists."""
    return reduce(DataFrame.union, [x.select("id") for x in lists]).distinct()


#: Lists whose marks share one number.
_MARKS = 62


def _marked(lists: tuple[DataFrame, ...]) -> tuple[DataFrame, list[str]]:
    """Each id with the lists that have it, as bits of columns of _MARKS bits; one aggregation, whatever their number."""
    names = [f"bits{w}" for w in range(-(-len(lists) // _MARKS))]
    bit = lambda k, w: F.lit(1 << k % _MARKS if k // _MARKS == w else 0).cast("bigint")
    rows = [x.select("id", *[bit(k, w).alias(name) for w, name in enumerate(names)]) for k, x in enumerate(lists)]
    return reduce(DataFrame.union, rows).groupBy("id").agg(*[F.bit_or(name).alias(name) for name in names]), names


def intersection(*lists: DataFrame) -> DataFrame:
    """Ids that every list has, by one aggregation whatever their number."""
    held, names = _marked(lists)
    full = [F.col(name) == (1 << min(_MARKS, len(lists) - w * _MARKS)) - 1 for w, name in enumerate(names)]
    return held.where(reduce(lambda a, b: a & b, full)).select("id")


def missing_counts(*lists: DataFrame) -> DataFrame:
    """(id, missing): in how many of the lists an id that some list has is missing."""
    held, names = _marked(lists)
    have = reduce(lambda a, b: a + b, [F.bit_count(name) for name in names])
    return held.select("id", (F.lit(len(lists)) - have).cast("int").alias("missing"))


def equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether two lists hold the same ids, repeats aside; ends at the first one that differs."""
    marked = a.select("id", F.lit(1).alias("side")).union(b.select("id", F.lit(2)))
    return marked.groupBy("id").agg(F.bit_or("side").alias("sides")).where("sides <> 3").isEmpty()


def same(a: Column, b: Column) -> Column:
    """Whether two sorted lists are equal, element by element."""
    return F.coalesce(a == b, a.isNull() & b.isNull())


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two results (score, id) as one, bucket by bucket: an id stands once in each bucket that either has it in."""
    return a.select("score", "id").union(b.select("score", "id")).distinct()


def right_biased(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    """Two tables with unique keys as one; of a key that both have, the second one's row."""
    return b.unionByName(a.join(b.select(key), key, "left_anti"))


def narrow(own: Column, other: Column) -> Column:
    """A list narrowed to another: their common ids; an empty list takes over the other's."""
    return F.when(F.size(own) == 0, F.array_sort(F.array_distinct(other))).otherwise(F.array_sort(F.array_intersect(own, other)))


def narrow_to_any(own: Column, others: Column) -> Column:
    """The same with the union of an array of lists."""
    return narrow(own, F.flatten(others))


def added(own: Column, value: Column) -> Column:
    """A list with a value, in its place."""
    return F.array_sort(F.array_union(own, F.array(value)))


def overlaps(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)


def shown(ids: Column) -> Column:
    """Ids joined by commas."""
    return F.array_join(F.transform(F.array_sort(ids), lambda x: x.cast("string")), ",")
