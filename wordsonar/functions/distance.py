"""The keyboard-weighted edit distance, for one pair and for a query against many words of one length at once.

A substitution costs 0 to 2 (see keyboard.cost), a swap of neighbouring characters 2, an insertion or deletion 2, but 1
in the last row (after the query's last character). The distance is directed: query first, target second.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .keyboard import CODES, COSTS, KEY_OF, NUMBER, cost


def distance(query: str, target: str, most: int | None = None) -> int:
    """The distance, or most + 1 if it is greater than most."""
    if most is not None and most < 0:
        raise ValueError("a bound below 0")
    if not query or not target:
        found = 2 * (len(query) + len(target))
    elif most is not None and abs(len(query) - len(target)) > most:
        found = most + 1
    elif query == target:
        found = 0
    else:
        found = int(distances(query, _chars([target]))[0])
    return found if most is None else min(found, most + 1)


def _chars(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix of code points."""
    return np.array([[ord(c) for c in w] for w in words], dtype=np.int32).reshape(len(words), -1)


_numbers = np.zeros(0x10000, dtype=np.int16)
for _c, _n in NUMBER.items():
    _numbers[ord(_c)] = _n


def _number(points: np.ndarray) -> np.ndarray:
    return np.where(points < 0x10000, _numbers[np.minimum(points, 0xFFFF)], 0)


def distances(query: str, targets: np.ndarray) -> np.ndarray:
    """From a query to each row of a matrix of code points."""
    rows, n = targets.shape
    m = len(query)
    numbers = _number(targets)
    codes = CODES[numbers]
    before, last = None, np.tile(2 * np.arange(n + 1, dtype=np.int32)[:, None], (1, rows))
    for i in range(1, m + 1):
        ch = query[i - 1]
        step = 1 if i == m else 2
        costs = np.where(targets == ord(ch), 0, COSTS[NUMBER.get(ch, 0)][numbers]).T
        now = np.empty_like(last)
        now[0] = 2 * i
        for j in range(1, n + 1):
            best = np.minimum(np.minimum(last[j], now[j - 1]) + step, last[j - 1] + costs[j - 1])
            if i > 1 and j > 1 and query[i - 2] in KEY_OF and ch in KEY_OF:
                crossed = (codes[:, j - 2] == KEY_OF[ch]) & (codes[:, j - 1] == KEY_OF[query[i - 2]])
                best = np.where(crossed, np.minimum(best, before[j - 2] + 2), best)
            now[j] = best
        before, last = last, now
    return last[n]


def up_to_one(query: str, target: str) -> int:
    """0, 1, or 2 for more: equal lengths by the sum of costs, lengths one apart by one free insertion that costs 1."""
    if len(query) == len(target):
        return min(2, sum(map(cost, query, target)))
    if abs(len(query) - len(target)) != 1:
        return 2
    short, long = sorted((query, target), key=len)
    # costs are asked from the query's side
    same = (lambda i, j: cost(short[i], long[j]) == 0) if short is query else (lambda i, j: cost(long[j], short[i]) == 0)
    i = 0
    while i < len(short) and same(i, i):
        i += 1
    return 1 if all(same(k, k + 1) for k in range(i, len(short))) else 2


def phonetic_distance(query: str, key: str) -> int:
    """0 if the key begins with the query, else up_to_one from the query to as much of the key and one character."""
    return 0 if key.startswith(query) else up_to_one(query, key[: len(query) + 1])


def window_distances(query: str, words: list[str], in_word: bool) -> np.ndarray:
    """From a query to each word, none shorter: to its beginning, or in_word to its nearest part of the same length."""
    n = len(query)
    out = np.zeros(len(words), dtype=np.int32)
    if not in_word:
        starts = list({w[:n] for w in words})
        found = dict(zip(starts, distances(query, _chars(starts)).tolist(), strict=True)) if starts else {}
        out[:] = [found[w[:n]] for w in words]
        return out
    parts = list({w[i : i + n] for w in words for i in range(len(w) - n + 1)})
    found = dict(zip(parts, distances(query, _chars(parts)).tolist(), strict=True)) if parts else {}
    out[:] = [min(found[w[i : i + n]] for i in range(len(w) - n + 1)) for w in words]
    return out


def near_matcher(wanted: list[tuple[str, bool, int]]):
    """For mapInPandas over a column `term`: rows (q, key, d) of every wanted (query, in_word, bound) within its bound."""

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            terms = pdf["term"].tolist()
            found = []
            for query, in_word, most in wanted:
                some = [t for t in terms if len(t) >= len(query)]
                d = window_distances(query, some, in_word)
                hits = np.flatnonzero(d <= most)
                if len(hits):
                    found.append(pd.DataFrame({"q": query, "key": [some[k] for k in hits], "d": d[hits]}))
            if found:
                yield pd.concat(found)

    return match


def phonetic_matcher(wanted: list[str]):
    """For mapInPandas over columns (q, key) of candidates: those within 1."""

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.assign(d=np.array([phonetic_distance(q, k) for q, k in zip(pdf["q"], pdf["key"], strict=True)], dtype=np.int32))
            yield pdf[pdf["d"] <= 1]

    return match


def keyboard_distance(query: str, target: Column, most: int | None = None) -> Column:
    """The distance from a query to each value of a column (null for null); most + 1 stands for more than most."""

    @F.pandas_udf("int")
    def of(words: pd.Series) -> pd.Series:
        distinct = {w: distance(query, w, most) for w in words.dropna().unique()}
        return words.map(distinct).astype("Int32")

    return of(target)
