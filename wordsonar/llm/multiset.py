"""Document fingerprints by a homomorphic multiset hash, with DataFrame functions only.

A text's paragraphs (lines) are hashed whole, and in pieces: clauses (parted by . ! ? , ; : |), long ones in runs of PIECE
characters from their start on, blank ones left out. The fingerprint is a sum of wide vectors over them, so it does not
depend on the paragraphs' order, and a paragraph is inserted or deleted by adding or subtracting its own vector:

* STRONG lanes: sums modulo 2 ** 32 of parts of the SHA-256 of each whole paragraph, for equality;
* the count of pieces, and LANES narrow lanes: how many pieces have a certain bit of their 64-bit hash set, modulo
  2 ** 32. Two lanes share a long, 32 bits apart, and are added by one addition; no text has so many pieces that one
  would run over into the other.

A narrow lane minus half the count of pieces is a sum of +-1/2 values; the cosine of two such vectors estimates how
much of their pieces two texts share. Likeness is 1 for equal fingerprints, else that cosine cut to 0 to 1.

The texts are shuffled once, by ranges of ids; all sums, and the step to the next document, keep that partitioning.

Defined results: a null text is an empty one, and an empty text is one empty paragraph; repeated rows are documents of
their own; rows go by doc_id (null first), then text (rows without an id, and those of one id, are one range: its task sorts and
spills them); a table of one row is its own next document; an empty table gives
no rows; extra columns are not read.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lanes of 32 bits for equality; narrow lanes for likeness, as many as a hash has bits; characters of a piece at most.
STRONG, LANES, PIECE = 6, 64, 16
_MASK = 1 | 1 << 32
_LOW32 = (1 << 32) - 1
#: Documents in a range of ids, about, and ranges at most: one id of each is broadcast (some 3 MB). With more than 67 million
#: documents ranges grow, as sorts that spill.
RANGE, RANGES = 512, 1 << 17


def parts(text: Column, edited: bool) -> Column:
    """array<struct<edited, strong, h>>: the digests of a text's paragraphs (strong) and the hashes of its pieces."""
    none = F.lit(None)
    whole = lambda p: F.struct(F.lit(edited).alias("edited"), F.sha2(F.encode(p, "UTF-8"), 256).alias("strong"), none.cast("bigint").alias("h"))
    piece = lambda c: F.struct(F.lit(edited).alias("edited"), none.cast("string").alias("strong"), F.xxhash64(F.trim(c)).alias("h"))
    pieces = F.filter(F.regexp_extract_all(text, F.lit(rf"[^.!?,;:|\n]{{1,{PIECE}}}"), F.lit(0)), lambda c: F.trim(c) != "")
    return F.concat(F.transform(F.split(text, "\n"), whole), F.transform(pieces, piece))


def sums() -> list[Column]:
    """Aggregates over rows of parts: s0.. (strong lanes), pieces, w0.. (two narrow lanes each)."""
    h, strong = F.col("h"), F.col("strong")
    lane = lambda k: F.conv(F.substring(strong, 8 * k + 1, 8), 16, 10).cast("bigint")
    out = [F.coalesce(F.sum(F.when(strong.isNotNull(), lane(k))), F.lit(0)).alias(f"s{k}") for k in range(STRONG)]
    out.append(F.count(h).alias("pieces"))
    bits = [F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_MASK)) for k in range(LANES // 2)]
    return out + [F.coalesce(F.sum(x), F.lit(0)).alias(f"w{k}") for k, x in enumerate(bits)]


def joined() -> Column:
    """The sums as one array: strong lanes modulo 2 ** 32, pieces, narrow lanes."""
    strong = [F.col(f"s{k}").bitwiseAND(F.lit(_LOW32)) for k in range(STRONG)]
    narrow = [F.shiftrightunsigned(F.col(f"w{k % (LANES // 2)}"), 32 * (k // (LANES // 2))).bitwiseAND(F.lit(_LOW32)) for k in range(LANES)]
    return F.array(*strong, F.col("pieces"), *narrow)


def shown(lanes: Column) -> Column:
    """The fingerprint as text: eight hex digits of every lane."""
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    centred = lambda x: F.transform(F.slice(x, STRONG + 2, LANES), lambda c: (2 * c - F.element_at(x, STRONG + 1)).cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    x, y = centred(a), centred(b)
    norm = F.sqrt(dot(x, x) * dot(y, y))
    return F.when(a == b, 1.0).when(norm == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(x, y) / norm)))


def fingerprints(docs: DataFrame, text_col="text", *keys: str) -> DataFrame:
    """keys (which tell rows apart) and the array `lanes` of each text's fingerprint."""
    source = docs.select(*keys, F.explode(parts(F.coalesce(F.col(text_col), F.lit("")), False)).alias("part"))
    return source.select(*keys, "part.strong", "part.h").groupBy(*keys).agg(*sums()).select(*keys, joined().alias("lanes"))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of two texts' paragraphs together, or with sign -1 of the first without those of the second."""
    moduli = [_LOW32 + 1] * STRONG + [1 << 62] + [_LOW32 + 1] * LANES
    return F.zip_with(F.zip_with(a, b, lambda p, q: p + sign * q), F.array(*map(F.lit, moduli)), lambda s, m: F.pmod(s, m))


def _ranges(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with the column range, and (range, guard, id): the range that each range's first document ends. Ranges part at
    quantiles of the ids, so they hold about as many documents each, however the ids are spread."""
    count = min(RANGES, -(-docs.count() // RANGE) or 1)
    cuts: list[int] = []
    if count > 1:
        places = ", ".join(f"{i / count!r}D" for i in range(1, count))
        cuts = sorted(set(docs.agg(F.expr(f"percentile_approx(doc_id, array({places}), {4 * count})")).first()[0] or []))
    # the range of an id is found in two steps, over about as many cuts each
    step = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    starts = F.from_json(F.lit(json.dumps([g[0] for g in groups])), "array<bigint>")
    inner = F.from_json(F.lit(json.dumps([[], *groups])), "array<array<bigint>>")
    below = lambda cuts: F.size(F.filter(cuts, lambda x: x <= F.col("doc_id")))
    docs = docs.withColumn("range", F.when(F.col("doc_id").isNull(), -1).otherwise(below(starts)))
    docs = docs.withColumn("range", F.when(F.col("range") > 0, (F.col("range") - 1) * step + below(F.element_at(inner, F.greatest("range", F.lit(0)) + 1))).otherwise(F.col("range")))
    firsts = docs.groupBy("range").agg(F.min("doc_id").alias("id"))
    by = Window.partitionBy(F.lit(0)).orderBy("range")
    whole = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = firsts.select(F.col("range").alias("first_range"), "id", F.coalesce(F.lag("range").over(by), F.last("range").over(whole)).alias("ends"))
    return docs, ends


def report(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row; the edited
    text has its last quarter replaced by the beginning of the next document."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows, ends = _ranges(rows)
    # the first document of a range also stands as a guard behind the range before; RANGES bounds what is broadcast
    same = F.col("range").eqNullSafe(F.col("first_range")) & F.col("doc_id").eqNullSafe(F.col("id"))
    guards = rows.join(F.broadcast(ends), same).select("doc_id", "text", F.col("ends").alias("range"), F.lit(True).alias("guard"))
    rows = rows.select("doc_id", "text", "range", F.lit(False).alias("guard")).union(guards)
    order = Window.partitionBy("range").orderBy("guard", F.asc_nulls_first("doc_id"), "text")
    rows = rows.select("*", F.lead("text").over(order).alias("next"), F.row_number().over(order).alias("n"))
    n = F.length("text")
    k = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - k), F.substring(F.coalesce("next", F.lit("")), F.lit(1), k))
    rows = rows.select("range", "n", "guard", "doc_id", n.cast("bigint").alias("n_chars"), "text", edited.alias("edit"))
    keys = ["range", "n", "guard", "doc_id", "n_chars", "edited_sha256"]
    # the digest comes before the explosion, lest it be taken again for every part
    rows = rows.select(*keys[:-1], F.sha2(F.encode("edit", "UTF-8"), 256).alias("edited_sha256"), F.concat(parts(F.col("text"), False), parts(F.col("edit"), True)).alias("parts"))
    rows = rows.select(*keys, F.explode("parts").alias("part"))
    found = rows.select(*keys, "part.*").groupBy(*keys, "edited").agg(*sums()).select(*keys, "edited", joined().alias("lanes"))
    order = Window.partitionBy("range").orderBy("n", "edited")
    found = found.select("*", F.lead("lanes", 1).over(order).alias("own"), F.lead("lanes", 2).over(order).alias("other"))
    return found.where("not edited and not guard").select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("lanes")).alias("fingerprint"), shown(F.col("own")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("own")).alias("near_edited"), likeness(F.col("lanes"), F.col("other")).alias("near_next"),
    )
