"""An index that grows with a stream of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import postings


def grow(stream: DataFrame, path: str, checkpoint: str, id_col="id", text_col="text", delimiters: str | None = None, keep_numbers: bool = False, **trigger) -> StreamingQuery:
    """Appends the postings of each micro-batch under path/batch=<n>. A batch that runs again overwrites its own
    folder, so each is written once; read the postings with `current`."""

    def write(batch: DataFrame, n: int) -> None:
        found = postings(batch, id_col, text_col, delimiters, keep_numbers)
        found.sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark, path: str) -> DataFrame:
    """(term, id) of all batches; a pair that came in several is one row."""
    return spark.read.parquet(path).select("term", "id").distinct()
