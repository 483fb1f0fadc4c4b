"""Typo-tolerant and sound-alike word search over text columns, on Spark DataFrames."""

import importlib

_HOME = {"Search": ".plans.engine"} | dict.fromkeys(
    ("ErrorCode", "Location", "MatchMode", "Options", "PrecisionType", "SearchError", "SearchRequest", "SearchType"), ".model"
)
__all__ = sorted(_HOME)


def __getattr__(name: str):
    """Names come when first asked for, so tasks load only the modules that they run."""
    if name not in _HOME:
        raise AttributeError(name)
    return getattr(importlib.import_module(_HOME[name], __name__), name)
