"""How names spread over the keys of an encoder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_buckets(names: DataFrame, keys: Column, name_col: str = "name") -> DataFrame:
    """(key, name): a row for each name and distinct key."""
    return names.select(F.explode(keys).alias("key"), F.col(name_col).alias("name"))


def key_distribution(names: DataFrame, keys: Column) -> DataFrame:
    """One row: source, encoded, skipped, unique_keys, links, avg_bucket, max_bucket, over_1, over_5, over_10, ratio."""
    counts = names.select(F.size(keys).alias("n")).agg(F.count("*").alias("source"), F.count_if(F.col("n") > 0).alias("encoded"))
    sizes = names.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    over = lambda k: F.count_if(F.col("n") > k).alias(f"over_{k}")
    found = sizes.agg(F.count("*").alias("unique_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("links"), F.coalesce(F.max("n"), F.lit(0)).alias("max_bucket"), over(1), over(5), over(10))
    share = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.when(F.col(b) != 0, F.col(b)))
    # two rows of one each
    return counts.join(found).select(
        "source", "encoded", (F.col("source") - F.col("encoded")).alias("skipped"), "unique_keys", "links", share("links", "unique_keys").alias("avg_bucket"),
        "max_bucket", "over_1", "over_5", "over_10", share("unique_keys", "source").alias("ratio"),
    )


def largest_buckets(buckets: DataFrame, most: int = 15, sample: int = 10) -> DataFrame:
    """(key, n, names) of the largest buckets, ties by key; of each the first names in order."""
    top = buckets.groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(most)
    # a fixed number of keys; their names are cut to the sample before they are gathered
    rows = buckets.join(F.broadcast(top), "key").withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("name"))).where(F.col("r") <= sample)
    return rows.groupBy("key", "n").agg(F.sort_array(F.collect_list("name")).alias("names"))
