"""Connected components of a graph whose links lie in a table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table


def _star(links: DataFrame, large: bool) -> DataFrame:
    """large: every larger neighbour of a node goes to the node's least neighbour (or itself, if that is less).
    small: the node and its smaller neighbours go to the least of these."""
    if large:
        both = links.union(links.select("v", "u"))
    else:
        both = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of `links` (u, v): label is the least node of its component.

    Each round is one job over the links alone; they are written to the shared folder, so a lost executor costs a part
    of one round. A node with many links is dealt by joins and partial aggregates only, never gathered in one task.
    Rounds grow with the logarithm of the longest chain. Null ends and loops are ignored.
    """
    now = Table(links.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(most_rounds):
        sums = now.df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if not sums[0]:
            break
        after = Table(_star(_star(now.df, True), False), "links")
        same = sums == after.df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        now.drop()
        now = after
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    found = now.df.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return found.union(found.select(F.col("label").alias("node"), "label").distinct())
