"""Word search: builds an index from a source, checks requests, plans and runs searches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import query_terms
from ..model import ErrorCode, Location, MatchMode, Options, SearchError, SearchRequest, SearchType
from ..operators import combine as _combine
from ..operators import index as _index
from ..operators import match as _match
from ..sources import records as _records
from . import policy as _policy


class Buckets(dict):
    """{score: ids ascending}, scores ascending. A score that no id has gives an empty tuple."""

    def __missing__(self, score: int) -> tuple:
        return ()

    @property
    def has_any(self) -> bool:
        return bool(self)


class Search:
    """Search by words over one index. Settings out of range are ignored when set, as they were.

    Results are DataFrames (score, id): lower scores are better, an id occurs once. bucket_merge says what a near search
    does with several words at one distance: "intersect" keeps the ids that all of them have, "union" those that any has.
    """

    def __init__(self, spark: SparkSession, phonetic: bool = False, encoder: _index.Encoder | None = None, bucket_merge: str = "intersect"):
        if spark is None:
            raise ValueError("a search needs a Spark session")
        if bucket_merge not in ("intersect", "union"):
            raise ValueError("bucket_merge is intersect or union")
        self.spark, self.is_phonetic, self.encoder, self.bucket_merge = spark, phonetic or encoder is not None, encoder, bucket_merge
        self.search_type, self.location = SearchType.EXACT, Location.BEGIN_WORD
        self.index: _index.Index | None = None
        self.on_index_complete: list[Callable[[bool], None]] = []
        self.on_index_created: list[Callable[[_index.Index], None]] = []
        self._precision = self._misprints = -1
        self._numbers = self._complete = False

    # --- settings ---

    @property
    def is_number_search(self) -> bool:
        """Whether words with digits are indexed; never in sound search."""
        return self._numbers

    @is_number_search.setter
    def is_number_search(self, value: bool) -> None:
        if not self.is_phonetic:
            self._numbers = bool(value)

    @property
    def precision(self) -> int:
        """The share of a word, in percent, that must be right in a near search; -1: unset."""
        return self._precision

    @precision.setter
    def precision(self, value: int) -> None:
        if 0 <= value <= 100:
            self._precision = value

    @property
    def misprints(self) -> int:
        """The distance allowed in a near search; -1: unset. Goes before precision."""
        return self._misprints

    @misprints.setter
    def misprints(self, value: int) -> None:
        if value >= 0:
            self._misprints = value

    @property
    def is_index_complete(self) -> bool:
        return self._complete

    @is_index_complete.setter
    def is_index_complete(self, value: bool) -> None:
        self._complete = value
        for call in self.on_index_complete:
            call(value)

    # --- sources ---

    def prepare_index(self, records: DataFrame, id_col: str = "id", text_col: str = "text", delimiters: str | None = None, partitions: int | None = None, force_parallel: bool = False, threshold: int = _policy.THRESHOLD) -> Search:
        """Builds the index of a table. An empty table raises and leaves the former index usable; a null text, as any
        other failure of the build, raises INDEX_BUILD_FAILED.

        partitions deals the records to that many tasks; force_parallel, or more records than threshold, to as many as
        the policy gives for the cores at hand. Else they stay in the partitions that they come in."""
        if records is None or records.isEmpty():
            raise SearchError(ErrorCode.INVALID_SOURCE_RECORD, "the source has no records")
        rows = records.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        cores = self.spark.sparkContext.defaultParallelism
        if not partitions and (force_parallel or threshold < _policy.THRESHOLD):
            count = 0 if force_parallel else rows.count()
            if _policy.should_use_parallel(cores, force_parallel, count, threshold):
                partitions = max(_policy.degree_of_parallelism(cores), rows.rdd.getNumPartitions())
        return self._build(rows.repartition(partitions) if partitions else rows, delimiters)

    def prepare_index_from_lines(self, lines: list[str | None] | DataFrame, delimiter: str, delimiters: str | None = None, id_kind: str = "int", lenient: bool = False) -> Search:
        """Builds the index of lines "<id><delimiter><text>": a list, or a DataFrame with the column line (or value)."""
        if isinstance(lines, DataFrame):
            if lines.isEmpty():
                raise SearchError(ErrorCode.INVALID_SOURCE_RECORD, "the source has no lines")
            table = lines if "line_no" in lines.columns else _records.numbered(lines, "line" if "line" in lines.columns else "value")
        else:
            if not lines:
                raise SearchError(ErrorCode.INVALID_SOURCE_RECORD, "the source has no lines")
            table = _records.lines_of(self.spark, list(lines))
        return self._build(_records.from_lines(table, delimiter, id_kind, lenient), delimiters)

    def use(self, index: _index.Index) -> Search:
        """Takes over an index, such as a loaded one."""
        self._reset()
        self.index, self.is_phonetic = index, index.phonetic
        self.is_index_complete = True
        return self

    def _reset(self) -> None:
        self.is_index_complete = False
        if self.index:
            self.index.unpersist()
        self.index = None

    def _build(self, rows: DataFrame, delimiters: str | None) -> Search:
        self._reset()
        try:
            text = F.when(F.col("text").isNull(), F.raise_error(F.lit("a record has no text"))).otherwise(F.col("text"))
            words = _index.tokens(rows.select("id", text.alias("text")), "id", "text", delimiters, self._numbers)
            index = _index.Index.build(words, self.is_phonetic, self.encoder)  # errors of the data come now, as the caller expects
        except Exception as e:
            raise SearchError(ErrorCode.INDEX_BUILD_FAILED, "the index could not be built") from e
        self.index = index
        for call in self.on_index_created:
            call(index)
        self.is_index_complete = True
        return self

    # --- searches ---

    def terms(self, query: str) -> list[str]:
        """What is looked for: a query's words, or in sound search all their keys."""
        words = query_terms(query)
        if self.is_phonetic:
            words = sorted({k for w in words for k in _index.key_list(self.encoder, w)})
        return list(words)

    def _options(self, request: SearchRequest) -> Options:
        pick = lambda value, own: own if value is None else value
        return Options(
            pick(request.search_type, self.search_type), pick(request.location, self.location),
            pick(request.precision, self._precision), pick(request.misprints, self._misprints),
        )

    def _checked(self, queries: dict[str, str], request: SearchRequest | None) -> tuple[dict[str, list[str]], SearchRequest]:
        if not queries or any(not (q or "").strip() for q in queries.values()):
            raise SearchError(ErrorCode.EMPTY_QUERY, "the query is empty")
        if not self.index or not self.is_index_complete:
            raise SearchError(ErrorCode.INDEX_NOT_BUILT, "no index has been built")
        if self.index.is_empty():
            raise SearchError(ErrorCode.INDEX_IS_EMPTY, "the index has no terms")
        request = request or SearchRequest()
        request.validate()
        found = {name: self.terms(q) for name, q in queries.items()}
        if not all(found.values()):
            raise SearchError(ErrorCode.QUERY_HAS_NO_SEARCHABLE_TERMS, "the query has no word to search for")
        return found, request

    def find(self, query: str, request: SearchRequest | None = None, candidates: bool = True) -> DataFrame:
        """(score, id) of one query."""
        return self.find_batch({"": query}, request, candidates).select("score", "id")

    def find_batch(self, queries: dict[str, str], request: SearchRequest | None = None, candidates: bool = True) -> DataFrame:
        """(query_id, score, id) of several queries under one request: one pass over the index for all."""
        asked, request = self._checked(queries, request)
        try:
            distinct = sorted({t for terms in asked.values() for t in terms})
            found = _match.matches(self.index, distinct, self._options(request), self.bucket_merge == "union", candidates)
            return _combine.combine(found, asked, MatchMode(request.match_mode))
        except SearchError:
            raise
        except Exception as e:
            raise SearchError(ErrorCode.SEARCH_EXECUTION_FAILED, "the search failed") from e

    def find_buckets(self, query: str, request: SearchRequest | None = None) -> Buckets:
        """The result by score, on the driver: for results small enough to look at."""
        rows = _combine.buckets(self.find(query, request)).orderBy("score").collect()
        return Buckets((r.score, list(r.ids)) for r in rows)
