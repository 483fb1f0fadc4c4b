"""Toxicity by gradient-boosted trees over dense features of a text, with isotonic calibration.

Features are densities of lexicon words (a short list of insults, and words learned from labelled texts by their log
odds), their weights, how near they stand to a second-person word, and rates of capitals, punctuation and obfuscated
spelling. Trees of small depth are boosted on the logistic loss over binned features; a calibration by isotonic
regression on rows that the trees have not seen turns their sum into a probability.

The model is fitted on about FIT_ROWS labelled rows at most, chosen by a hash of the id; word counts are aggregated by
Spark, only features (some numbers per row) come to the driver. Scoring reads every whole text once, where it is.

Defined results: a null text is an empty one and gets the score of its features (all zero); labels other than 0 and 1
and rows with a null label or id teach nothing; equal labels of an id teach one example, different ones one each, and of
several texts under one id the least in order is theirs, so a frequent id can't outgrow the bound; without any labelled
row, or with one class only, every score is the share of ones (0 without rows); extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

#: Labelled rows that the model is fitted on, about; words in the learned lexicon.
FIT_ROWS, LEARNED = 20_000, 300
#: Texts with a learned word must number this at least.
SUPPORT = 5
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb fool loser losers scum trash garbage pathetic worthless disgusting clown jerk "
    "hate kill die ugly freak pig rat liar creep damn hell crap shit fuck fucking bastard bitch asshole retard cretin "
    "idiota imbecil estupido basura idiote imbecile connard salaud ordure dummkopf trottel arschloch abschaum".split()
)
YOU = frozenset("you your yours yourself u ur ye du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes ti tus su".split())
#: Spellings by other signs, undone before the lexicon is asked.
_PLAIN = str.maketrans("@4310!|$5780", "aaeioiisstbo")
_TOKEN = re.compile(r"[^\W_](?:[\w@$!|*.'’-]*[\w@$!|*])?")
#: Letters with such signs or digits among them, and letters parted by dots, stars or dashes. A run of letters is gone
#: through once, whatever its length: a search begins at its start, and what it has taken it doesn't give back.
_ODD = re.compile(r"(?<![A-Za-z])[A-Za-z]++(?:[@$!|*0-9][@$!|*0-9.]*+[A-Za-z]++)+|[A-Za-z](?:[.*-][A-Za-z]){2,}")
_RUN = re.compile(r"([A-Za-z])\1{2,}")
_CAPITALS, _DIGITS, _MARKS, _LOUD = bytes(range(65, 91)), b"0123456789", b".,;:!?-\"'()*#", b"!?"
_ASCII = re.compile("[\x00-\x7f]+")
_NEAR = 5
NAMES = ("words", "insults", "learned", "weight", "greatest", "hits", "near_you", "you", "capitals", "shouted", "exclaims", "punctuation", "odd", "odd_hits", "runs", "digits", "length")


@dataclass
class Lexicon:
    learned: dict[str, float] = field(default_factory=dict)

    def features(self, text: str) -> list[float]:
        """Linear in the text's length, whatever its words."""
        words = _TOKEN.findall(text)
        n, chars = len(words), len(text)
        low = [w.lower() for w in words]
        weights = self.learned
        hits = [i for i, w in enumerate(low) if w in weights or w in INSULTS]
        found = [weights.get(low[i], 0.0) for i in hits]
        insults = sum(low[i] in INSULTS for i in hits)
        you = [i for i, w in enumerate(low) if w in YOU]
        near = 0
        if hits and you:
            at = np.array(you)
            place = np.searchsorted(at, hits)
            gap = np.minimum(np.abs(at[np.maximum(place - 1, 0)] - hits), np.abs(at[np.minimum(place, len(at) - 1)] - hits))
            near = int((gap <= _NEAR).sum())
        odd = _ODD.findall(text)
        odd_hits = 0
        for w in odd and words:
            if not w.isalpha():
                plain = re.sub(r"[.*'’-]", "", w.lower().translate(_PLAIN))
                odd_hits += plain in INSULTS or plain in weights
        coded = text.encode()
        count = lambda signs: len(coded) - len(coded.translate(None, signs))
        rest = "" if text.isascii() else _ASCII.sub("", text)
        capitals = count(_CAPITALS) + sum(map(str.isupper, rest))
        digits = count(_DIGITS) + sum(map(str.isdigit, rest))
        per, each = 1000 / max(n, 1), 1 / max(chars, 1)
        return [
            np.log1p(n), insults * per, sum(x > 0 for x in found) * per, sum(found) * per, max(found, default=0.0), np.log1p(len(hits) + odd_hits), near * per, len(you) * per,
            capitals * each, sum(len(w) > 1 and w.isupper() for w in words) * per, count(_LOUD) * each,
            count(_MARKS) * each, len(odd) * per, odd_hits * per, len(_RUN.findall(text)) * per,
            digits * each, chars / max(n, 1),
        ]

    def matrix(self, texts: list[str]) -> np.ndarray:
        return np.array([self.features(t) for t in texts], dtype=np.float64).reshape(len(texts), len(NAMES))


class Boosted:
    """Boosted trees of fixed depth on binned features: arrays of split features, bins and leaf values."""

    def __init__(self, trees: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 64, ridge: float = 5.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b, k = self.binned(x), x.shape[1]
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.start = np.log(share / (1 - share))
        raw = np.full(len(y), self.start)
        self.feature, self.cut, self.leaf = [], [], []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), dtype=np.int64)
            features, cuts = [], []
            for level in range(self.depth):
                n = 1 << level
                gains, at = np.zeros(n), np.zeros((n, 2), dtype=np.int64)
                at[:, 1] = self.bins  # no row is above: the node stays whole
                for f in range(k):
                    key = node * self.bins + b[:, f]
                    sg = np.bincount(key, g, n * self.bins).reshape(n, self.bins).cumsum(axis=1)
                    sh = np.bincount(key, h, n * self.bins).reshape(n, self.bins).cumsum(axis=1)
                    tg, th = sg[:, -1:], sh[:, -1:]
                    gain = sg**2 / (sh + self.ridge) + (tg - sg) ** 2 / (th - sh + self.ridge) - tg**2 / (th + self.ridge)
                    best = gain.argmax(axis=1)
                    better = gain[np.arange(n), best] > gains + 1e-9
                    gains[better] = gain[np.arange(n), best][better]
                    at[better] = np.column_stack((np.full(n, f), best))[better]
                features.append(at[:, 0])
                cuts.append(at[:, 1])
                node = 2 * node + (b[np.arange(len(y)), at[node, 0]] > at[node, 1])
            sg, sh = (np.bincount(node, v, 1 << self.depth) for v in (g, h))
            leaf = self.rate * sg / (sh + self.ridge)
            raw += leaf[node]
            self.feature.append(features)
            self.cut.append(cuts)
            self.leaf.append(leaf)
        return self

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)]) if len(x) else np.zeros((0, x.shape[1]), np.int64)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, rows = self.binned(x), np.arange(len(x))
        out = np.full(len(x), self.start)
        for features, cuts, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for f, c in zip(features, cuts, strict=True):
                node = 2 * node + (b[rows, f[node]] > c[node])
            out += leaf[node]
        return out


class Isotonic:
    """The monotone least-squares fit of 0/1 outcomes over a score, joined by lines between the middles of its steps."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        values, place = np.unique(score, return_inverse=True)
        weight = np.bincount(place).astype(float)
        mean = np.bincount(place, y) / weight
        steps: list[list[float]] = []  # mean, weight, sum of scores
        for v, m, w in zip(values, mean, weight, strict=True):
            steps.append([m, w, v * w])
            while len(steps) > 1 and steps[-2][0] >= steps[-1][0]:
                m2, w2, s2 = steps.pop()
                m1, w1, s1 = steps[-1]
                steps[-1] = [(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, s1 + s2]
        # a pseudo-count keeps the ends off 0 and 1
        share = y.mean()
        self.x = np.array([s / w for _, w, s in steps])
        self.y = np.array([(m * w + share) / (w + 1) for m, w, _ in steps])
        self.y = np.maximum.accumulate(self.y)
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        out = np.interp(score, self.x, self.y)
        # within a flat end the order of the scores stays visible
        return np.clip(out + 1e-4 * (np.tanh(score / 8)), 0, 1)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Boosted | None
    scale: Isotonic | None
    share: float

    def inputs(self, texts: list[str]) -> np.ndarray:
        return self.lexicon.matrix(texts) if self.trees else np.zeros((len(texts), 1))

    def of(self, inputs: np.ndarray) -> np.ndarray:
        """The score of each row of inputs."""
        return self.scale(self.trees.raw(inputs)) if self.trees else np.full(len(inputs), self.share)

    def score(self, texts: list[str]) -> np.ndarray:
        return self.of(self.inputs(texts))


def _features(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                x = shared.value.matrix([t.as_py().decode() for t in utf8(batch.column("text"))])
                yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["h", "y", "x"])

    return rows.select("h", "y", "text").mapInArrow(run, "h bigint, y int, x array<double>")


def learn(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", fit_rows: int = FIT_ROWS) -> Model:
    """A model of the labels of docs' texts; docs are the rows that may be learned from."""
    marks = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and id is not null")
    marks = marks.distinct().join(docs.select(F.col(id_col).cast("bigint").alias("id")).where("id is not null").distinct(), "id", "left_semi")
    n = marks.count()
    part = min(1.0, fit_rows / max(n, 1))
    marks = marks.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000)) < int(part * 1_000_000))
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # about fit_rows pairs of numbers at most: small enough to send
    rows = texts.join(F.broadcast(marks), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    rows = rows.select(F.xxhash64("id", F.lit(11)).alias("h"), "y", "text")
    words = rows.select("y", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}'@$!*]+"))).alias("word")).where("length(word) between 2 and 40")
    counts = words.groupBy("word").agg(F.sum("y").alias("pos"), F.count("*").alias("n")).where(F.col("n") >= SUPPORT)
    total, ones = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not ones or ones == total:
        return Model(Lexicon(), None, None, float(ones / total) if total else 0.0)
    odds = F.log((F.col("pos") + 0.5) / (ones + 1.0)) - F.log((F.col("n") - F.col("pos") + 0.5) / (total - ones + 1.0))
    # what the odds say beyond chance: words that few texts have must be purer
    sure = odds * F.sqrt(F.col("pos").cast("double"))
    best = counts.where(F.col("pos") >= 3).select("word", odds.alias("odds"), sure.alias("sure")).where("odds > 1").orderBy(F.desc("sure"), "word").limit(LEARNED)
    lexicon = Lexicon({w: float(o) for w, o, _ in best.collect()})
    found = sorted((r.h, r.y, r.x) for r in _features(rows, lexicon).collect())
    h, y, x = np.array([r[0] for r in found]), np.array([r[1] for r in found], dtype=float), np.array([r[2] for r in found])
    aside = h % 4 == 0
    if y[aside].sum() in (0, aside.sum()) or y[~aside].sum() in (0, (~aside).sum()):
        aside = np.zeros(len(h), dtype=bool)
    trees = Boosted().fit(x[~aside], y[~aside])
    rest = aside if aside.any() else ~aside
    return Model(lexicon, trees, Isotonic().fit(trees.raw(x[rest]), y[rest]), float(y.mean()))


def score(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, score, predicted of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            rows = [shared.value.inputs([t.as_py().decode() for t in utf8(b.column("text"))]) for b in slices(whole, "text")]
            scores = shared.value.of(np.concatenate(rows)) if rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([whole.column("doc_id"), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, score double, predicted int")
