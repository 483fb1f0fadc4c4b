"""Words of texts and of queries: upper case, delimiters, filters."""

from __future__ import annotations

import re
import sys
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that part words unless an index is given its own.
DELIMITERS = ".,()-:;!?\"\\'$_=[]<>/«»“” …’\t"

#: Letters with an upper case of one character, and that. Others stay as they are, and so does the dotless i, whose upper case
#: is another letter's too.
_LOWER = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c != "ı" and len(c.upper()) == 1 and c.upper() != c)
_UPPER = _LOWER.upper()
_TO_UPPER = str.maketrans(_LOWER, _UPPER)


def simple_upper(text: Column) -> Column:
    """Upper case, one character for one, whatever the locale."""
    return F.translate(text, _LOWER, _UPPER)


def simple_upper_str(text: str) -> str:
    return text.translate(_TO_UPPER)


def delimiter_class(delimiters: str | None) -> str:
    """A regular expression for one delimiter, the same in Java, RE2 and Python."""
    return "[" + "".join("\\" + c if c in "\\[]^-&~" else c for c in delimiters or DELIMITERS) + "]"


def words(text: Column, delimiters: str | None = None, keep_numbers: bool = False) -> Column:
    """The array of a text's words: parted by delimiters, upper case, two characters or more, without digits unless
    keep_numbers. Null for a null text."""
    if (delimiters or "").upper() == (delimiters or "").lower():
        found = F.split(simple_upper(text), delimiter_class(delimiters))
    else:  # delimiters are looked for in the text as it is
        found = F.transform(F.split(text, delimiter_class(delimiters)), simple_upper)
    if keep_numbers:
        return F.filter(found, lambda w: F.length(w) > 1)
    return F.filter(found, lambda w: (F.length(w) > 1) & ~F.rlike(w, F.lit(r"\p{Nd}")))


@lru_cache(maxsize=4096)
def query_terms(query: str) -> tuple[str, ...]:
    """A query's distinct words in the order of their code points. Always the default delimiters, digits allowed."""
    parts = re.split(delimiter_class(None), simple_upper_str(query.strip()))
    return tuple(sorted({sys.intern(p) for p in parts if len(p) > 1}))
