"""Options, requests, errors and results of a search."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum, IntEnum


class MatchMode(IntEnum):
    """How the words of a query combine."""

    ALL_TERMS = 0
    ANY_TERM = 1
    SOFT_ALL_TERMS = 2


class SearchType(IntEnum):
    EXACT = 0
    NEAR = 1


class Location(IntEnum):
    """Where in an indexed word a query word is looked for."""

    BEGIN_WORD = 0
    IN_WORD = 1


class PrecisionType(IntEnum):
    """Declared for completeness; no operator depends on it."""

    PERCENT = 0
    MISPRINTS = 1


class ErrorCode(Enum):
    EMPTY_QUERY = "EmptyQuery"
    QUERY_HAS_NO_SEARCHABLE_TERMS = "QueryHasNoSearchableTerms"
    INDEX_NOT_BUILT = "IndexNotBuilt"
    INDEX_IS_EMPTY = "IndexIsEmpty"
    INVALID_SEARCH_OPTIONS = "InvalidSearchOptions"
    INVALID_SEARCH_REQUEST = "InvalidSearchRequest"
    INVALID_SOURCE_RECORD = "InvalidSourceRecord"
    INVALID_DELIMITED_SOURCE_FORMAT = "InvalidDelimitedSourceFormat"
    INVALID_ID_FORMAT = "InvalidIdFormat"
    MANUAL_INDEXING_ALREADY_STARTED = "ManualIndexingAlreadyStarted"
    MANUAL_INDEXING_NOT_STARTED = "ManualIndexingNotStarted"
    RESOURCE_INITIALIZATION_FAILED = "ResourceInitializationFailed"
    INDEX_BUILD_FAILED = "IndexBuildFailed"
    SEARCH_EXECUTION_FAILED = "SearchExecutionFailed"


class SearchError(Exception):
    """What went wrong: a code, a message and, if another exception is the reason, that one as __cause__."""

    def __init__(self, code: ErrorCode, message: str):
        super().__init__(message)
        self.code, self.message = code, message

    def __reduce__(self):
        return SearchError, (self.code, self.message)


@dataclass(frozen=True)
class SearchRequest:
    """One search's mode, and settings that override the engine's own for it (None: the engine's)."""

    match_mode: MatchMode = MatchMode.ALL_TERMS
    search_type: SearchType | None = None
    location: Location | None = None
    precision: int | None = None
    misprints: int | None = None

    def validate(self) -> None:
        def bad(message: str) -> SearchError:
            return SearchError(ErrorCode.INVALID_SEARCH_REQUEST, message)

        for value, kind, name in ((self.match_mode, MatchMode, "match mode"), (self.search_type, SearchType, "search type"), (self.location, Location, "search location")):
            if value is None and kind is not MatchMode:
                continue
            try:
                kind(value)
            except ValueError:
                raise bad(f"{value!r} is no {name}") from None
        if self.precision is not None and not 0 <= self.precision <= 100:
            raise bad("precision lies outside 0 to 100")
        if self.misprints is not None and self.misprints < 0:
            raise bad("misprints are negative")


@dataclass(frozen=True)
class Options:
    """The settings in force for one search."""

    search_type: SearchType
    location: Location
    precision: int
    misprints: int

    def allowed(self, length: int) -> int:
        """The greatest distance at which a word of this length still matches in a near search."""
        if self.misprints >= 0:
            return self.misprints
        # integer division that cuts toward zero, also for the unset precision of -1
        return length - int(length * self.precision / 100) if length > 1 else 0
