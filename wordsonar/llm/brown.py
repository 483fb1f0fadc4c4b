"""A class-based bigram model with classes from exchange clustering.

P(word | word before) = MIX * P(class | class before) * P(word | class) + (1 - MIX) * P(word). Classes come in two steps.
Exchange clustering moves each of the TOP most frequent words to the class that raises the likelihood of the class bigrams
most, over and over, until few move; that gives the classes as which words are seen by the word after them: other words
are seen as the class of the frequent words that share their longest ending. Then every word of the training texts that
occurs LEAST times or more (every one) is exchanged, whatever their number: a table holds how often each word follows each class, and
in each of ROUNDS passes over it all words move at once to the class that makes the classes before them likeliest, given
the counts of the pass before (from the frequent words' ones at first). Words that were never seen
(and rarer ones, if LEAST is raised) take the class of their ending. Emissions and the unigram part are smoothed by half a count, with one further word of each
class for all that were never seen, and class transitions by half a count.

The score of a text splits into a sum of log10(count + 0.5) over its tokens and a sum over pairs of a class before and a
class. Counts and classes of the HEAD most frequent words go to every task (their number bounds what is sent); tokens of
other words meet the table of all words by a join, one row for each document, word and class before. That table, the class
bigrams and the class sizes are gathered from all training documents. The driver holds the TOP words' matrix, the HEAD
words and tables of classes by classes, whatever the number of words.

Defined results: a null or empty text is a text of one token, its end; repeated rows count and score each for
themselves (a repeated id too); null ids are kept; with no training document every count is zero and there is one class;
ties of frequency go by the word; extra columns are not read. Words outside the HEAD list are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, chunks, hashes_at, signed, slices, utf8, word_hashes, word_spans

#: Words of the first clustering, classes, words whose counts go to every task, weight of the class part.
TOP, CLASSES, HEAD, MIX = 1000, 64, 100_000, 0.9
#: Occurrences from which on a word is exchanged by itself (1: every word), and passes of that. With 3 and 6 held-out texts of
#: the driver's 0.1 tables have a perplexity 0.7 and 1.7 % greater.
LEAST, ROUNDS = 1, 5
#: Distinct words that a task counts before it passes the counts on; tokens whose neighbours it counts together.
COUNTED, TOGETHER = 150_000, 1_000_000
#: Passes of exchange clustering at most.
PASSES = 12
#: The token that ends a text; no word has white space.
END = b"\n"
_END_HASH = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_ENDING = 4


def tokens(text: bytes) -> list[bytes]:
    return [*text.translate(_LOWER).split(), END]


def endings(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The last _ENDING bytes of each word (the last one lowest) and, above them, how many these are."""
    size = np.minimum(ends - starts, _ENDING)
    code = size.astype(np.uint64) << np.uint64(8 * _ENDING)
    for k in range(_ENDING):
        there = np.flatnonzero(size > k)
        code[there] |= b[ends[there] - 1 - k].astype(np.uint64) << np.uint64(8 * k)
    return code


def coded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of some texts, one text after the other: hashes and endings; and the number of each text's tokens."""
    line = b"\n".join(texts).translate(_LOWER)
    parts = []
    for at, b in chunks(line):
        starts, ends = word_spans(b)
        parts.append((hashes_at(b, starts, ends), endings(b, starts, ends), starts + at))
    hashes, tails, starts = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    of = np.searchsorted(begins, starts, side="right") - 1
    counts = np.bincount(of, minlength=len(texts))
    place = np.arange(len(hashes)) + of
    out, out_tails = np.full(len(hashes) + len(texts), _END_HASH), np.zeros(len(hashes) + len(texts), dtype=np.uint64)
    out[place], out_tails[place] = hashes, tails
    return out, out_tails, counts + 1


def hashes_of(words: list[bytes]) -> np.ndarray:
    """The hashes of words, in their order."""
    out = np.full(len(words), _END_HASH)
    out[[k for k, w in enumerate(words) if w != END]] = word_hashes(b" ".join(w for w in words if w != END))
    return out


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of all tokens; each task adds up what it can hold before the shuffle."""

    def give(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for whole in batches:
            for batch in slices(whole, "text"):
                for text in utf8(batch.column("text")):
                    seen.update(tokens(text.as_py()))
                if len(seen) > COUNTED:
                    yield give(seen)
                    seen = Counter()
        if seen:
            yield give(seen)

    return texts.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def exchange(pairs: np.ndarray, classes: int, passes: int = PASSES) -> np.ndarray:
    """The class of each word, given the matrix of counts of (word before, word). The last row and column stand for all
    other words, which keep a class of their own (classes - 1)."""
    n = len(pairs)
    total = pairs.sum(axis=1) + pairs.sum(axis=0)
    of = np.arange(n) % (classes - 1)
    of[-1] = classes - 1
    pairs = pairs.astype(np.float64)
    right = np.zeros((n, classes))  # of each word: how often a class follows
    left = np.zeros((n, classes))  # and how often a class precedes
    for c in range(classes):
        right[:, c], left[:, c] = pairs[:, of == c].sum(axis=1), pairs[of == c].sum(axis=0)
    table = np.array([right[of == c].sum(axis=0) for c in range(classes)])
    log = lambda v: v * np.log(np.maximum(v, 1))
    order = np.argsort(-total[:-1], kind="stable")
    for _ in range(passes):
        moved = 0
        for w in order:
            if not total[w]:
                continue
            a, self_pairs = of[w], pairs[w, w]
            r, le = right[w].copy(), left[w].copy()
            r[a] -= self_pairs
            le[a] -= self_pairs
            # without the word
            table[a] -= right[w]
            table[:, a] -= le
            rows, columns = table.sum(axis=1), table.sum(axis=0)
            base = log(table)
            add_row = log(table + r[None, :]) - base
            add_column = log(table + le[:, None]) - base
            both = np.arange(classes)
            cross = log(table[both, both] + r + le + self_pairs) - base[both, both]
            gain = add_row.sum(axis=1) + add_column.sum(axis=0) - add_row[both, both] - add_column[both, both] + cross
            gain -= log(rows + r.sum() + self_pairs) - log(rows) + log(columns + le.sum() + self_pairs) - log(columns)
            b = int(gain[:-1].argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            if b != a:
                moved += 1
                right[:, a] -= pairs[:, w]
                right[:, b] += pairs[:, w]
                left[:, a] -= pairs[w]
                left[:, b] += pairs[w]
                of[w] = b
            table[b] += right[w]
            le = left[w].copy()
            le[b] -= self_pairs
            table[:, b] += le
        if moved <= len(order) // 200:
            break
    return of


@dataclass
class Classes:
    """The class of every word: by itself if it is known here, else by its ending."""

    known: dict[bytes, int]
    endings: dict[bytes, int]
    other: int

    def of(self, word: bytes) -> int:
        c = self.known.get(word)
        if c is None:
            for n in range(_ENDING, 0, -1):
                c = self.endings.get(word[-n:])
                if c is not None:
                    return c
            return self.other
        return c

    @staticmethod
    def make(words: list[bytes], counts: list[int], of: np.ndarray, other: int) -> Classes:
        votes: dict[bytes, Counter] = {}
        for w, n, c in zip(words, counts, of, strict=True):
            for k in range(1, _ENDING + 1 if w != END else 0):
                if len(w) >= k:
                    votes.setdefault(w[-k:], Counter())[int(c)] += n
        found = {e: min(v, key=lambda c: (-v[c], c)) for e, v in votes.items()}
        return Classes({w: int(c) for w, c in zip(words, of, strict=True)}, found, other)


class Coder:
    """Hashes and endings of tokens to places in a list of words (or -1) and to classes, many at once."""

    def __init__(self, words: list[bytes], classes: Classes):
        hashes = hashes_of(words)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.class_of = np.array([classes.of(w) for w in words], dtype=np.int64)
        self.other, self.by_ending = classes.other, []
        for k in range(_ENDING, 0, -1):
            own = sorted((int.from_bytes(e, "big"), c) for e, c in classes.endings.items() if len(e) == k)
            # the last byte is the lowest of the code
            self.by_ending.append((k, np.array([x for x, _ in own], dtype=np.uint64), np.array([c for _, c in own], dtype=np.int64)))

    def places(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)

    def ending_classes(self, tails: np.ndarray) -> np.ndarray:
        """The class of each ending."""
        size = (tails >> np.uint64(8 * _ENDING)).astype(np.int64)
        out, left = np.full(len(tails), self.other), np.arange(len(tails))
        for k, codes, kinds in self.by_ending:
            if not len(codes) or not len(left):
                continue
            own = tails[left] & np.uint64((1 << 8 * k) - 1)
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            met = (codes[at] == own) & (size[left] >= k)
            out[left[met]] = kinds[at[met]]
            left = left[~met]
        return out

    def classes(self, places: np.ndarray, tails: np.ndarray) -> np.ndarray:
        out = self.class_of[places] if len(self.class_of) else np.zeros(len(places), np.int64)
        rest = np.flatnonzero(places < 0)
        out[rest] = self.ending_classes(tails[rest])
        return out


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for whole in batches:
        for batch in slices(whole, "text"):
            yield coded(utf8(batch.column("text")).to_pylist())[:2]


def _before(codes: np.ndarray, end: int) -> np.ndarray:
    """What stands before each token; before a text stands the end of another."""
    return np.concatenate(([end], codes[:-1]))


def _matrix(texts: DataFrame, shared, size: int) -> np.ndarray:
    """How often each of the first words (the last row and column: all others) follows each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, total = shared.value, np.zeros(size * size, dtype=np.int64)
        place = lambda hashes: np.where((p := coder.places(hashes)) < 0, size - 1, p)
        end = place(np.array([_END_HASH]))[0]
        for hashes, _ in _flat(batches):
            c = place(hashes)
            total += np.bincount(_before(c, end) * size + c, minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    rows = texts.select("text").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n"))
    found = rows.toArrow()  # size * size rows at most
    out = np.zeros(size * size, dtype=np.int64)
    out[found["at"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(size, size)


def _neighbours(texts: DataFrame, shared, classes: int) -> DataFrame:
    """(w, n, e, befores): of each word, by its hash, its count, its ending's class and how often it follows each class."""

    def give(hashes: list[np.ndarray], tails: list[np.ndarray], before: list[np.ndarray], coder: Coder) -> pa.RecordBatch:
        words, first, place = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        kinds = coder.ending_classes(np.concatenate(tails)[first])
        at, counts = np.unique(place * classes + np.concatenate(before), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(signed(words)[at // classes]), pa.array((kinds[at // classes] * classes + at % classes).astype(np.int32)), pa.array(counts)], names=["w", "code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        end = coder.classes(coder.places(np.array([_END_HASH])), np.zeros(1, dtype=np.uint64))[0]
        kept, size = ([], [], []), 0
        for hashes, tails in _flat(batches):
            for own, more in zip(kept, (hashes, tails, _before(coder.classes(coder.places(hashes), tails), end)), strict=True):
                own.append(more)
            size += len(hashes)
            if size > TOGETHER:
                yield give(*kept, coder)
                kept, size = ([], [], []), 0
        if size:
            yield give(*kept, coder)

    rows = texts.select("text").mapInArrow(run, "w bigint, code int, n bigint").groupBy("w", "code").agg(F.sum("n").alias("n"))
    # a word's rows are now as many as there are classes, at most
    befores = F.collect_list(F.struct((F.col("code") % classes).cast("int").alias("h"), "n"))
    return rows.groupBy("w").agg(F.sum("n").alias("n"), F.min(F.floor(F.col("code") / classes).cast("int")).alias("e"), befores.alias("befores"))


class _Exchange:
    """Classes of words by the classes before them, given how often (row) each class is followed by each (column)."""

    def __init__(self, moves: np.ndarray, least: int):
        self.least = least
        total = moves.sum(axis=0)
        self.open = total > 0
        self.logs = np.log(moves + 0.5) - np.log(total + 0.5 * len(moves))[None, :]

    def of(self, befores: np.ndarray, n: np.ndarray, e: np.ndarray) -> np.ndarray:
        gain = np.where(self.open[None, :], befores @ self.logs, -np.inf)
        own = gain.argmax(axis=1)
        # a word stays with its ending where another class isn't likelier
        own = np.where(gain[np.arange(len(own)), own] > gain[np.arange(len(own)), e] + 1e-9, own, e)
        return np.where(n >= self.least, own, e)


def _rows_of(batch: pa.RecordBatch, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = batch.column("befores")
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    out = np.zeros((batch.num_rows, classes))
    np.add.at(out, (np.repeat(np.arange(batch.num_rows), sizes), flat.field("h").to_numpy()), flat.field("n").to_numpy())
    return out, batch.column("n").to_numpy(), batch.column("e").to_numpy().astype(np.int64)


def _moves(table: DataFrame, classes: int, choose) -> tuple[np.ndarray, np.ndarray]:
    """How often each class is followed by each, and how many words each has, if words are in the classes that
    choose(hashes, befores, n, e) names (below 0: left out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves, types = np.zeros((classes, classes)), np.zeros(classes)
        for batch in batches:
            rows, n, e = _rows_of(batch, classes)
            c = choose(batch.column("w").to_numpy().view(np.uint64), rows, n, e)
            there = np.flatnonzero(c >= 0)
            np.add.at(moves.T, c[there], rows[there])
            types += np.bincount(c[there], minlength=classes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes * classes + classes)), pa.array(np.concatenate((moves.ravel(), types)))], names=["at", "n"])

    found = table.mapInArrow(run, "at bigint, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # a row for each pair of classes
    out = np.zeros(classes * classes + classes)
    out[found["at"].to_numpy()] = found["n"].to_numpy()
    return out[: classes * classes].reshape(classes, classes), out[classes * classes :]


@dataclass
class Model:
    known: DataFrame  # w, n, c
    head: list[bytes]
    head_counts: np.ndarray
    classes: Classes  # of words as such; those outside the head are in the table
    seen: Classes  # of words as the word after them sees them
    total: int
    distinct: int
    pairs: np.ndarray  # log10 of what a token's (count + 0.5) is multiplied by, by class before and class


def most_frequent(counts: DataFrame, most: int) -> tuple[list[bytes], list[int]]:
    """About `most` words of the greatest counts and these, in order. Counts are told apart by eighths of a power of two,
    so no sort of all words is needed; of the words at the limit a share drawn by hash is taken."""
    level = F.floor(F.log2("n") * 8)
    sizes = counts.groupBy(level.alias("level")).count().collect()  # some hundreds of rows
    least, rest = 0, most
    for least, n in sorted(sizes, reverse=True):  # noqa: B007
        if n > rest:
            break
        rest -= n
    else:
        least, n = -1, 1
    drawn = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(rest / n * (1 << 30))
    found = counts.where((level > least) | (level == least) & drawn).toArrow()
    pairs = sorted(zip(found["word"].to_pylist(), found["n"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    return [w for w, _ in pairs], [n for _, n in pairs]


def learn(docs: DataFrame, text_col="text", top: int = TOP, classes: int = CLASSES, head: int = HEAD, mix: float = MIX, least: int = LEAST, rounds: int = ROUNDS) -> Model:
    texts = docs.select(F.col(text_col).alias("text"))
    sc = docs.sparkSession.sparkContext
    counted = Table(word_counts(texts), "counts")
    total, distinct = counted.df.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    words, numbers = most_frequent(counted.df, head)
    counted.drop()
    best, size = words[:top], len(words[:top]) + 1
    of = exchange(_matrix(texts, sc.broadcast(Coder(best, Classes({}, {}, 0))), size), classes) if size > 2 else np.full(size, classes - 1)
    seen = Classes.make(best, numbers[:top], of[:-1], classes - 1)
    first = Coder(best, seen)
    table = Table(_neighbours(texts, sc.broadcast(first), classes), "neighbours")

    def frequent(hashes, befores, n, e):
        at = first.places(hashes)
        return np.where(at < 0, -1, first.class_of[at] if len(first.class_of) else -1)

    moves, _ = _moves(table.df, classes, frequent)
    for _ in range(rounds):
        step = _Exchange(moves, least)
        moves, types = _moves(table.df, classes, lambda hashes, befores, n, e, step=step: step.of(befores, n, e))
    after = (moves + 0.5) / (moves.sum(axis=1, keepdims=True) + 0.5 * classes)
    emit = 1 / (moves.sum(axis=0) + 0.5 * (types + 1))
    plain = 1 / (total + 0.5 * (distinct + 1))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, n, e = _rows_of(batch, classes)
            yield pa.RecordBatch.from_arrays([batch.column("w"), batch.column("n"), pa.array(step.of(rows, n, e).astype(np.int32))], names=["w", "n", "c"])

    known = Table(table.df.mapInArrow(named, "w bigint, n bigint, c int"), "known").df
    table.drop()
    hashes = hashes_of(words)
    asked = sc.broadcast(np.sort(hashes))

    def among(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("w").to_numpy().view(np.uint64)
            at = np.minimum(np.searchsorted(asked.value, own), max(len(asked.value) - 1, 0))
            yield batch.filter(pa.array(asked.value[at] == own if len(asked.value) else np.zeros(len(own), dtype=bool)))

    found = known.mapInArrow(among, known.schema).select("w", "c").toArrow()  # the head's words
    kind = dict(zip(found["w"].to_numpy().view(np.uint64).tolist(), found["c"].to_pylist(), strict=True))
    own = Classes({w: kind[h] for w, h in zip(words, hashes.tolist(), strict=True)}, seen.endings, seen.other)
    return Model(known, words, np.array(numbers, dtype=np.int64), own, seen, total, distinct, np.log10(mix * after * emit[None, :] + (1 - mix) * plain))


def score(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row of docs."""
    sc = docs.sparkSession.sparkContext
    classes = len(model.pairs)
    seen, own = Coder(model.head, model.seen), Coder(model.head, model.classes)
    shared = sc.broadcast((seen, own.class_of, np.append(np.log10(model.head_counts + 0.5), np.log10(0.5)), model.pairs))
    names = ["doc_id", "row", "n_tokens", "known", "logs", "kinds", "words", "codes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, kinds, logs, pairs = shared.value
        end = coder.classes(coder.places(np.array([_END_HASH])), np.zeros(1, dtype=np.uint64))[0]
        for whole in batches:
            for batch in slices(whole, "text"):
                hashes, tails, counts = coded(utf8(batch.column("text")).to_pylist())
                place = coder.places(hashes)
                before = _before(coder.classes(place, tails), end)
                rest = np.flatnonzero(place < 0)
                kind = kinds[place] if len(kinds) else np.zeros(len(place), np.int64)
                kind[rest] = coder.ending_classes(tails[rest])
                starts = np.cumsum(counts) - counts
                add = lambda x, starts=starts: np.add.reduceat(x, starts)
                of = np.repeat(np.arange(len(counts)), counts)[rest]
                ends = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(counts))))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (signed(hashes[rest]), (before[rest] * classes + kind[rest]).astype(np.int32))]
                numbers = [counts.astype(np.int64), add((place >= 0).astype(np.int64)), add(logs[place]), add(pairs[before, kind])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *map(pa.array, numbers), *lists], names=names)

    # a row's own number, which stays as it is once the table is written
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    schema = "doc_id bigint, row bigint, n_tokens bigint, known bigint, logs double, kinds double, words array<bigint>, codes array<int>"
    scored = Table(source.mapInArrow(run, schema), "coded").df
    tail = scored.select("row", F.explode(F.arrays_zip("words", "codes")).alias("t")).select("row", F.col("t.words").alias("w"), F.col("t.codes").alias("code"))
    # what a word that is in the table adds to what a word that isn't has; the pairs of classes are a few thousand rows
    pairs = docs.sparkSession.createDataFrame(list(enumerate(model.pairs.ravel().tolist())), "code int, log double")
    own, other = (F.broadcast(pairs.select(F.col("code").alias(name), F.col("log").alias(f"{name}_log"))) for name in ("own", "other"))
    met = tail.join(model.known, "w").select("row", "n", F.col("code").alias("other"), (F.col("code") - F.col("code") % classes + F.col("c")).cast("int").alias("own"))
    met = met.join(own, "own").join(other, "other").select("row", (F.log10(F.col("n") + 0.5) - F.log10(F.lit(0.5))).alias("log"), (F.col("own_log") - F.col("other_log")).alias("kind"))
    met = met.groupBy("row").agg(F.count("*").alias("more"), F.sum("log").alias("log_more"), F.sum("kind").alias("kind_more"))
    both = scored.drop("words", "codes").join(met, "row", "left")
    logs = F.col("logs") + F.coalesce("log_more", F.lit(0.0))
    norm = float(np.log10(model.total + 0.5 * (model.distinct + 1)))
    return both.select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).cast("bigint").alias("n_known"), F.lit(model.total).cast("bigint").alias("train_tokens"),
        (logs - F.col("n_tokens") * norm).alias("base_score"), (logs + F.col("kinds") + F.coalesce("kind_more", F.lit(0.0))).alias("score"),
    )
