"""Byte-level BPE over a public vocabulary of ranks: encoding and decoding by DuckDB queries within each partition.

A text splits by the tokenizer's pattern; each distinct piece of a partition is encoded once by a recursive query: its
bytes are token-position rows, adjacent rows join the merge table (ranks by the bytes of both), and each step contracts
the leftmost pair of least rank in every piece until no pair has a rank. A piece of more than SHORT bytes is cut into
parts that the same query encodes; neighbours are joined by encoding the bytes around their joint, from a token's start
on the left to a token's end on the right, further and further until the first and the last token found are those that
stood there. All neighbouring tokens then are neighbours in some encoding, and with ranks under which every token's bytes
encode to the token itself (checked before the first long piece) there is one such sequence, the piece's encoding. So
time and memory grow with the piece and not with its square. Decoding joins the ids with the vocabulary and aggregates the bytes
in the order of the positions; a document's bytes are those of its pieces. Nothing is shuffled; a process's memory is
bounded by its cache of pieces (CACHE) and by the size of a slice of texts, it lets both go when no task comes for a
while, and a lost task is simply run again.

Defined results: null and empty texts give no ids and the digest of nothing; special-token strings are ordinary text;
repeated rows give repeated results; null ids stay null; extra columns are not read. The vocabulary must hold all 256
single bytes. Texts hold whole code points (Spark's strings do), so the pattern sees what the tiktoken library sees.
"""

from __future__ import annotations

import base64
import hashlib
import re
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cached_property

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, trim, utf8

#: Pieces whose ids a process remembers, and those of the texts at hand.
CACHE = 500_000
#: Bytes of a piece up to which the recursive query takes it whole, of the parts of a longer one, and of what is encoded
#: anew on either side of a joint at first.
SHORT, PART, REACH = 256, 32, 16
#: Bytes that the recursive query's places can tell apart.
PLACES = 1000
#: Squared bytes of the pieces in one recursive query; half as many rows are what it holds.
STEPS = 1_000_000
#: Pieces in one recursive query: places stay below 2 ** 31.
MOST = 1 << 20
#: Stands for no token; ids are below it.
_NONE = (1 << 20) - 1
#: Bytes of text encoded at once.
SLICE = 2 << 20

_FAST = re.compile("[\x00-\x7f" + re.escape("".join(chr(c) for c in range(0xA1, 0x100) if c not in (0xAD,))) + "]*")


def fast_pattern(pattern: str) -> re.Pattern:
    """The pattern for texts of Latin-1 characters only, with the character classes written out."""
    letters = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
    numbers = "0-9\xb2\xb3\xb9\xbc-\xbe"
    return re.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]"))


class Splitter:
    """Cuts texts into the pieces that a pattern matches."""

    def __init__(self, pattern: str):
        self.whole = regex.compile(pattern)
        # white space beyond ASCII differs between libraries, so texts that have it take the slower way
        self.fast = fast_pattern(pattern)

    def __call__(self, text: str) -> list[str]:
        if _FAST.fullmatch(text) and not re.search("[\x1c-\x1f]", text):
            return self.fast.findall(text)
        return self.whole.findall(text)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: A row is a token: its place (piece * 1024 + byte offset), its bytes' count, its id, the next token's id, and the token
#: that the merge table makes of both, if any. Each step contracts of each piece the leftmost pair of least rank, and asks
#: the merge table again for the two pairs that this changes.
_RECURSE = """
CREATE OR REPLACE TEMP TABLE coded AS
WITH RECURSIVE steps AS (
    SELECT s.place, s.size, s.token, s.next, m.token AS pair, 0::SMALLINT AS step
    FROM start s LEFT JOIN merges m ON m.pair = (s.token::BIGINT << 20) | s.next
    UNION ALL
    SELECT place, size, token, next, pair, step FROM (
        WITH best AS (
            SELECT place >> 10 AS piece, min((pair::BIGINT << 20) | ((place & 1023) << 10) | size) AS least
            FROM steps WHERE pair IS NOT NULL GROUP BY place >> 10
        ), joined AS (
            SELECT s.*, (b.least >> 20)::INT AS merged, (s.place & 1023) - ((b.least >> 10) & 1023)::INT AS off, (b.least & 1023)::INT AS width
            FROM steps s JOIN best b ON b.piece = s.place >> 10
        ), gone AS (
            SELECT place - off AS place, size, next FROM joined WHERE off = width
        ), moved AS (
            SELECT j.place, CASE WHEN off = 0 THEN j.size + g.size ELSE j.size END AS size,
                   CASE WHEN off = 0 THEN merged ELSE token END AS token,
                   CASE WHEN off = 0 THEN g.next WHEN off + j.size = 0 THEN merged ELSE j.next END AS next,
                   CASE WHEN off = 0 OR off + j.size = 0 THEN NULL ELSE pair END AS pair,
                   off = 0 OR off + j.size = 0 AS changed, step
            FROM joined j LEFT JOIN gone g ON g.place = j.place WHERE off <> width
        )
        SELECT v.place, v.size::SMALLINT AS size, v.token, v.next, CASE WHEN changed THEN m.token ELSE v.pair END AS pair, (step + 1)::SMALLINT AS step
        FROM moved v LEFT JOIN merges m ON m.pair = CASE WHEN changed THEN (v.token::BIGINT << 20) | v.next END
    )
), final AS (
    SELECT place >> 10 AS piece, max(step) AS step FROM steps GROUP BY piece
)
SELECT f.piece, s.place, s.token FROM steps s JOIN final f ON f.piece = s.place >> 10 AND f.step = s.step
"""
#: Of each piece its ids, and what these decode to.
_BOTH = """
SELECT piece, string_agg(token, ' ' ORDER BY place) AS ids, unhex(string_agg(v.hex, '' ORDER BY place)) AS bytes
FROM coded JOIN vocabulary v ON v.rank = token GROUP BY piece
"""

#: For what is longer than PLACES and has no joint (no case is known), a loop over tables.
#: A step over the table `long`: of each piece, the pairs of least rank that neither overlap one chosen before them nor
#: follow one whose contraction makes a pair of lesser rank with a neighbour; single steps would have taken that first.
_PAIRS = """
CREATE OR REPLACE TEMP TABLE pairs AS
SELECT s.*, m.rank FROM (
    SELECT piece, pos, hex, lead(hex) OVER w AS after, lead(hex, 2) OVER w AS after2, lag(hex) OVER w AS before,
           row_number() OVER w AS n
    FROM long WINDOW w AS (PARTITION BY piece ORDER BY pos)
) s LEFT JOIN vocabulary m ON m.hex = s.hex || s.after
"""
_CHOOSE = """
CREATE OR REPLACE TEMP TABLE chosen AS
WITH least AS (
    SELECT piece, min(rank) AS rank FROM pairs GROUP BY piece HAVING min(rank) IS NOT NULL
), hits AS (
    SELECT p.*, n - row_number() OVER (PARTITION BY piece ORDER BY n) AS run
    FROM pairs p JOIN least USING (piece, rank)
), apart AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY piece, run ORDER BY n) AS k FROM hits) WHERE k % 2 = 1
), judged AS (
    SELECT a.*, least(coalesce(x.rank, 1000000000), coalesce(y.rank, 1000000000)) < a.rank AS stop
    FROM apart a LEFT JOIN vocabulary x ON x.hex = a.before || a.hex || a.after
    LEFT JOIN vocabulary y ON y.hex = a.hex || a.after || a.after2
)
SELECT piece, n FROM (
    SELECT *, coalesce(sum(stop::INT) OVER (PARTITION BY piece ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stops
    FROM judged
) WHERE stops = 0
"""
_CONTRACT = """
CREATE OR REPLACE TEMP TABLE long AS
SELECT p.piece, p.pos, CASE WHEN c.n IS NOT NULL THEN p.hex || p.after ELSE p.hex END AS hex
FROM pairs p LEFT JOIN chosen c ON c.piece = p.piece AND c.n = p.n
LEFT JOIN chosen d ON d.piece = p.piece AND d.n + 1 = p.n
WHERE d.n IS NULL
"""

#: The same for ids that come as text.
_DECODE = """
SELECT k, unhex(string_agg(v.hex, '' ORDER BY pos)) AS bytes
FROM (SELECT k, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM (
    SELECT k, CAST(string_split(line, ' ') AS BIGINT[]) AS ids FROM lines_))
JOIN vocabulary v ON v.rank = id GROUP BY k
"""


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """Every pair of tokens whose bytes together are a token: first << 20 | second, and the token."""
    found = [(ranks[t[:k]] << 20 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    return pa.table({"pair": pa.array([p for p, _ in found], pa.int64()), "token": pa.array([r for _, r in found], pa.int32())})


_checked: dict[str, bool] = {}


def _proper(path: str, ranks: dict[bytes, int]) -> bool:
    """Whether each token's bytes encode to the token: its last contraction joins the encodings of its two parts, which
    are tokens of lesser rank, and no pair before it is of another kind. Once for each vocabulary and process."""
    if path not in _checked:
        _checked[path] = all(len(t) == 1 or _contracted(t, ranks) for t in ranks)
    return _checked[path]


def _contracted(t: bytes, ranks: dict[bytes, int]) -> bool:
    parts = [t[k : k + 1] for k in range(len(t))]
    while len(parts) > 1:
        found = [ranks.get(a + b, _NONE) for a, b in zip(parts, parts[1:])]
        k = found.index(least := min(found))
        if least == _NONE:
            return False
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return True


class Memory(dict):
    """What has been found for about `most` keys, in two generations: once the younger is full it becomes the elder, and
    what the elder has and nobody asked for meanwhile goes with it."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.elder = most // 2, {}

    def missing(self, here: set) -> list:
        """Those of the keys at hand that neither generation has; the others are in the younger one from now on."""
        if len(self) > self.most:
            self.elder = dict(self)
            self.clear()
        new, elder = [], self.elder
        for key in here.difference(self):
            if key in elder:
                self[key] = elder[key]
            else:
                new.append(key)
        return new


class Coder:
    """Encodes and decodes; one DuckDB database in memory, in one thread."""

    def __init__(self, path: str, pattern: str, cache: int = CACHE):
        self.split = Splitter(pattern)
        self.known, self.other = Memory(cache), {}
        ranks = load_ranks(path)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self._table("merges", merge_table(ranks))
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.path, self.ranks = path, ranks
        self._table("vocabulary", pa.table({"hex": [t.hex() for t in ranks], "rank": pa.array(ranks.values(), pa.int64())}))

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("rows_", rows)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM rows_")
        self.db.unregister("rows_")

    def close(self) -> None:
        self.db.close()

    @cached_property
    def proper(self) -> bool:
        return _proper(self.path, self.ranks)

    def _coded(self, pieces: list[bytes]) -> Iterator[tuple[int, str, bytes]]:
        """(place in pieces, ids joined by a space, the bytes that these stand for)"""
        batch, size = [], 0
        # pieces of like length need about as many steps
        for k in sorted(range(len(pieces)), key=lambda k: len(pieces[k])):
            p = pieces[k]
            if len(p) > SHORT and self.proper:
                ids = self._long(p)
                yield k, " ".join(map(str, ids)), self.decode([" ".join(map(str, ids))])[0]
                continue
            if len(p) > PLACES:
                yield k, *self._slow(p)
                continue
            batch.append(k)
            size += len(p) ** 2
            if size > STEPS or len(batch) == MOST:
                yield from self._short(batch, pieces)
                batch, size = [], 0
        if batch:
            yield from self._short(batch, pieces)

    def _short(self, batch: list[int], pieces: list[bytes]) -> Iterator[tuple[int, str, bytes]]:
        flat = np.frombuffer(b"".join([pieces[k] for k in batch]), dtype=np.uint8)
        sizes = np.fromiter((len(pieces[k]) for k in batch), np.int64, len(batch))
        offset = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = (np.repeat(np.arange(len(batch)), sizes) << 10 | offset).astype(np.int32)
        token = self.single[flat]
        after = np.append(token[1:], _NONE)
        after[np.cumsum(sizes) - 1] = _NONE
        self._table("start", pa.table({"place": place, "size": np.ones(len(flat), dtype=np.int16), "token": token, "next": after}))
        self.db.execute(_RECURSE)
        for k, ids, meant in self.db.execute(_BOTH).fetchall():
            yield batch[k], ids, meant

    def _ids(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each of some pieces, of which equal ones are encoded once."""
        each = list(dict.fromkeys(pieces))
        found: dict[bytes, list[int]] = {}
        at, size = 0, 0
        each.sort(key=len)
        for k, p in enumerate(each):
            size += len(p) ** 2
            if k + 1 == len(each) or size > STEPS or k + 1 - at == MOST or len(each[k + 1]) > PLACES:
                if len(p) > PLACES:
                    found[p] = list(map(int, self._slow(p)[0].split()))
                else:
                    found |= {each[n]: list(map(int, ids.split())) for n, ids, _ in self._short(list(range(at, k + 1)), each)}
                at, size = k + 1, 0
        return [found[p] for p in pieces]

    def _long(self, piece: bytes) -> list[int]:
        parts = self._ids([piece[k : k + PART] for k in range(0, len(piece), PART)])
        while len(parts) > 1:
            joined = self._join(list(zip(parts[0::2], parts[1::2], strict=False)))
            parts = joined + parts[-1:] * (len(parts) % 2)
        return parts[0]

    def _join(self, pairs: list[tuple[list[int], list[int]]]) -> list[list[int]]:
        """The encoding of each pair of encodings as one."""
        out: list = [None] * len(pairs)
        todo, reach = list(range(len(pairs))), REACH
        while todo:
            around = []
            for k in todo:
                left, right = pairs[k]
                around.append((self._within(reversed(left), reach), self._within(right, reach)))
            middles = self._ids([b"".join([self.bytes_of[t] for t in pairs[k][0][len(pairs[k][0]) - a :] + pairs[k][1][:b]]) for k, (a, b) in zip(todo, around, strict=True)])
            again = []
            for k, (a, b), middle in zip(todo, around, middles, strict=True):
                left, right = pairs[k]
                if (a == len(left) or middle[0] == left[-a]) and (b == len(right) or middle[-1] == right[b - 1]):
                    out[k] = left[: len(left) - a] + middle + right[b:]
                else:
                    again.append(k)
            todo, reach = again, 2 * reach
        return out

    def _within(self, tokens, reach: int) -> int:
        """How many tokens have so many bytes together, or all."""
        n = 0
        for t in tokens:
            n += 1
            reach -= len(self.bytes_of[t])
            if reach <= 0:
                break
        return n

    def _slow(self, piece: bytes) -> tuple[str, bytes]:
        self._table("long", pa.table({"piece": np.zeros(len(piece), dtype=np.int64), "pos": np.arange(len(piece)), "hex": [f"{b:02x}" for b in piece]}))
        while True:
            self.db.execute(_PAIRS)
            self.db.execute(_CHOOSE)
            if not self.db.execute("SELECT count(*) FROM chosen").fetchall()[0][0]:
                break
            self.db.execute(_CONTRACT)
        self.db.execute("CREATE OR REPLACE TEMP TABLE coded AS SELECT piece, pos AS place, rank AS token FROM long JOIN vocabulary USING (hex)")
        return self.db.execute(_BOTH).fetchall()[0][1:]

    def both(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Of each text: its ids, joined by a space, and the bytes that these stand for."""
        split = [self.split(t) for t in texts]
        new = self.known.missing(set().union(*split))
        coded = [p.encode() for p in new]
        for k, ids, meant in self._coded(coded):
            self.known[new[k]] = ids
            if meant != coded[k]:  # what decodes to the piece itself isn't held twice
                self.other[new[k]] = meant
        get, other = self.known.__getitem__, self.other
        for pieces in split:
            meant = b"".join([other.get(p) or p.encode() for p in pieces]) if other else "".join(pieces).encode()
            yield " ".join(map(get, pieces)), meant

    def encode(self, texts: list[str]) -> list[str]:
        """Of each text: its ids, joined by a space."""
        return [ids for ids, _ in self.both(texts)]

    def decode(self, lines: list[str]) -> list[bytes]:
        """Of each run of ids (joined by a space): the bytes that it stands for."""
        rows = [(k, line) for k, line in enumerate(lines) if line]
        self.db.register("lines_", pa.table({"k": pa.array([k for k, _ in rows], pa.int64()), "line": pa.array([x for _, x in rows], pa.string())}))
        found = dict(self.db.execute(_DECODE).fetchall())
        self.db.unregister("lines_")
        return [found.get(k, b"") for k in range(len(lines))]


#: Seconds without a task after which a process lets its coder go.
IDLE = 2.0
_coders: dict[tuple[str, str], Coder] = {}
_lock = threading.Lock()
_users = 0


def _let_go(seen: Coder) -> None:
    with _lock:
        if not _users and seen in _coders.values():
            _coders.clear()
            seen.close()


@contextmanager
def coder_of(path: str, pattern: str) -> Iterator[Coder]:
    """This process's coder: tasks that run here one soon after another share its tables and the pieces that it knows."""
    global _users
    with _lock:
        if (path, pattern) not in _coders:
            _coders.clear()
            trim()
            _coders[path, pattern] = Coder(path, pattern)
        coder, _users = _coders[path, pattern], _users + 1
        if timer := _timers.pop(path, None):
            timer.cancel()
    try:
        yield coder
    finally:
        with _lock:
            _users -= 1
            _timers[path] = timer = threading.Timer(IDLE, _let_go, (coder,))
            timer.daemon = True
            timer.start()


_timers: dict[str, threading.Timer] = {}


def _sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def encode(docs: DataFrame, path: str, pattern: str, id_col="doc_id", text_col="text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded_sha256, and with_ids the ids."""
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with coder_of(path, pattern) as coder:
            for whole in batches:
                for batch in slices(whole, "text", SLICE):
                    lines, decoded = [], []
                    for line, meant in coder.both([t.as_py().decode() for t in utf8(batch.column("text"))]):
                        lines.append(line)
                        decoded.append(_sha(meant))
                    counts = pa.array([line.count(" ") + 1 if line else 0 for line in lines], pa.int64())
                    out = [batch.column("doc_id"), counts, pa.array([_sha(line.encode()) for line in lines], pa.string()), pa.array(decoded, pa.string())]
                    if with_ids:
                        out.append(pa.array([list(map(int, line.split())) for line in lines], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(out)])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
