"""The registered queries as SQL for DuckDB. Searches have literal queries, so distances unroll to columns."""

from __future__ import annotations

from .functions import keyboard
from .functions.phonetic import APART, ENDS, MARKS, SOUNDS, STRICT, VOWELS, keys_str
from .functions.text import delimiter_class, query_terms
from .model import Location, MatchMode, Options, SearchType
from .queries import BATCH, CUSTOMERS, DOCS, EXACT, LATIN_NAMES, LINES, NAMES, NEAR, PARTS, SOFT, SOUND


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def upper(text: str) -> str:
    aside = "\ue100\ue101"
    return f"translate(upper(translate({text}, 'ßı', '{aside}')), '{aside}', 'ßı')"


def source(of: tuple[str, str, str]) -> str:
    name, key, text = of
    return f"SELECT {key} AS id, {text} AS text FROM {name}"


def values(rows: list[tuple], columns: str) -> str:
    show = lambda x: "NULL" if x is None else lit(x) if isinstance(x, str) else str(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS v({columns})"


def posts(rows: str, delimiters: str | None = None, numbers: bool = False) -> str:
    digits = "" if numbers else r" AND NOT regexp_matches(term, '\p{Nd}')"
    parts = f"SELECT id, unnest(regexp_split_to_array(text, {lit(delimiter_class(delimiters))})) AS term FROM ({rows})"
    return f"SELECT DISTINCT term, id FROM (SELECT id, {upper('term')} AS term FROM ({parts})) WHERE length(term) > 1{digits}"


# --- exact ---


def exact_hits(terms: list[str], location: Location) -> str:
    """q, id, d from the relation p."""
    holds = "starts_with" if location == Location.BEGIN_WORD else "contains"
    return " UNION ".join(f"SELECT {lit(q)} AS q, id, 0 AS d FROM p WHERE {holds}(term, {lit(q)})" for q in terms)


# --- near ---


def _same(ch: str) -> list[str]:
    return [c for c in keyboard.CHARS if keyboard.cost(ch, c) == 0] or [ch]


def _close(ch: str) -> list[str]:
    return [c for c in keyboard.CHARS if keyboard.cost(ch, c) == 1]


def _in(at: str, chars: list[str]) -> str:
    return f"{at} IN ({', '.join(map(lit, chars))})" if chars else "false"


def dynamic(query: str, targets: str) -> str:
    """t, d of a query to targets (t) of its own length."""
    n = len(query)
    sql = f"SELECT t, {', '.join(f'{2 * j} AS c0_{j}' for j in range(n + 1))} FROM ({targets})"
    for i in range(1, n + 1):
        step, ch = (1 if i == n else 2), query[i - 1]
        cells = [f"{2 * i} AS c{i}_0"]
        for j in range(1, n + 1):
            at = f"substr(t, {j}, 1)"
            cost = f"CASE WHEN {_in(at, _same(ch))} THEN 0 WHEN {_in(at, _close(ch))} THEN 1 ELSE 2 END"
            options = [f"c{i - 1}_{j} + {step}", f"c{i}_{j - 1} + {step}", f"c{i - 1}_{j - 1} + {cost}"]
            if i > 1 and j > 1 and ch in keyboard.KEY_OF and query[i - 2] in keyboard.KEY_OF:
                crossed = f"{_in(f'substr(t, {j - 1}, 1)', _same(ch))} AND {_in(at, _same(query[i - 2]))}"
                options.append(f"CASE WHEN {crossed} THEN c{i - 2}_{j - 2} + 2 ELSE 1000 END")
            cells.append(f"least({', '.join(options)}) AS c{i}_{j}")
        sql = f"SELECT *, {', '.join(cells)} FROM ({sql})"
    return f"SELECT t, c{n}_{n} AS d FROM ({sql})"


def near_keys(query: str, location: Location, most: int) -> str:
    """q, key, d from the relation p."""
    n = len(query)
    terms = f"SELECT DISTINCT term FROM p WHERE length(term) >= {n}"
    parts = f"SELECT term, substr(term, 1, {n}) AS t FROM ({terms})"
    if location == Location.IN_WORD:
        parts = f"SELECT term, substr(term, i, {n}) AS t FROM (SELECT term, unnest(range(1, length(term) - {n} + 2)) AS i FROM ({terms}))"
    found = dynamic(query, f"SELECT DISTINCT t FROM ({parts})")
    return f"SELECT {lit(query)} AS q, term AS key, min(d) AS d FROM ({parts}) JOIN ({found}) USING (t) GROUP BY term HAVING min(d) <= {most}"


def near_hits(terms: list[str], location: Location, options: Options, union: bool) -> str:
    plain = [q for q in terms if len(q) == 2 or options.allowed(len(q)) == 0]
    fuzzy = [q for q in terms if q not in plain]
    parts = [exact_hits(plain, location)] if plain else []
    for q in fuzzy:
        keys = near_keys(q, location, options.allowed(len(q)))
        every = "" if union else "HAVING count(*) = any_value(need)"
        parts.append(
            f"SELECT q, id, d FROM (SELECT q, key, d, count(*) OVER (PARTITION BY d) AS need FROM ({keys})) k JOIN p ON p.term = k.key GROUP BY q, id, d {every}"
        )
    return " UNION ".join(f"({x})" for x in parts)


# --- combination ---


def combined(hits: str, terms: list[str], mode: MatchMode) -> str:
    """score, id of hits q, id, d."""
    best = f"SELECT q, id, min(d) AS d FROM ({hits}) GROUP BY q, id"
    n = len(terms)
    if n == 1 or mode == MatchMode.ANY_TERM:
        return f"SELECT min(d)::INT AS score, id FROM ({best}) GROUP BY id"
    sums = f"SELECT id, sum(d) AS total, count(*) AS n FROM ({best}) GROUP BY id"
    if mode == MatchMode.ALL_TERMS:
        return f"SELECT total::INT AS score, id FROM ({sums}) WHERE n = {n}"
    return f"SELECT (total + ({n} - n) * (max(total) OVER () + 1))::INT AS score, id FROM ({sums})"


def search(rows: str, hits: str, terms: list[str], mode: MatchMode, numbers: bool = False) -> str:
    return f"WITH p AS ({posts(rows, numbers=numbers)}) {combined(hits, terms, mode)}"


# --- sound ---

_DOUBLES = "array_to_string(list_filter(string_split({x}, ''), lambda c, i: i = 1 OR c <> string_split({x}, '')[i - 1]), '')"


def sound(text: str, approx: bool = True) -> str:
    """The key of a name in Cyrillic letters; '' for others."""
    plain = f"translate(upper(regexp_replace({text}, '[\\s–—''’-]', '', 'g')), 'ЁЬЪ', 'Е')"
    x = f"translate({plain}, '{STRICT[0]}', '{STRICT[1]}')"
    if approx:
        x = f"translate({x}, '{VOWELS[0]}', '{VOWELS[1]}')"
    return f"CASE WHEN regexp_matches({plain}, '^[А-Я]+$') THEN {_DOUBLES.format(x=x)} ELSE '' END"


def latin_names() -> str:
    """id, language, cyrillic, approx of names in Latin letters: cut into spellings, the first that fits at each place."""
    cut = f"regexp_extract_all(upper(text), {lit('|'.join(s for s, _ in SOUNDS) + f'|{APART}|.')})"
    letter = "CASE " + " ".join(f"WHEN c = {lit(s)} THEN {lit(c)}" for s, c in SOUNDS) + f" WHEN regexp_matches(c, {lit(APART)}) THEN '' END"
    spelled = f"SELECT id, text, list_transform({cut}, lambda c: {letter}) AS parts FROM ({values(LATIN_NAMES, 'id, text')})"
    written = f"""SELECT id, CASE WHEN regexp_matches(upper(text), {lit(f"{MARKS}|({ENDS})$")}) THEN 'RussianLatin' ELSE 'Unknown' END AS language,
        CASE WHEN list_contains(list_transform(parts, lambda c: c IS NULL), true) THEN '' ELSE array_to_string(parts, '') END AS cyrillic FROM ({spelled})"""
    return f"SELECT id::BIGINT AS id, language, cyrillic, CASE WHEN language = 'Unknown' THEN '' ELSE {sound('cyrillic')} END AS approx FROM ({written})"


def sound_posts(rows: str) -> str:
    return f"SELECT DISTINCT key AS term, id FROM (SELECT id, {sound('term')} AS key FROM ({posts(rows)})) WHERE key <> ''"


def up_to_one(q: str) -> str:
    """The distance of the column t (as long as q, or one longer) from q: 0, 1 or 2."""
    n = len(q)
    costs = " + ".join(f"CASE WHEN {_in(f'substr(t, {j + 1}, 1)', _same(c))} THEN 0 WHEN {_in(f'substr(t, {j + 1}, 1)', _close(c))} THEN 1 ELSE 2 END" for j, c in enumerate(q))
    skips = []
    for gap in range(n + 1):
        skips.append("(" + " AND ".join(_in(f"substr(t, {j + 1 + (j >= gap)}, 1)", _same(c)) for j, c in enumerate(q)) + ")")
    return f"CASE WHEN length(t) = {n} THEN least(2, {costs}) WHEN {' OR '.join(skips)} THEN 1 ELSE 2 END"


def sound_hits(terms: list[str]) -> str:
    parts = []
    for q in terms:
        n = len(q)
        near = {q, *(q[:i] + q[i + 1 :] for i in range(n))}
        cuts = "SELECT term, substr(term, 1, i - 1) || substr(term, i + 1) AS v FROM (SELECT term, unnest(range(1, length(term) + 1)) AS i FROM v)"
        keys = f"SELECT term FROM ({cuts} UNION SELECT term, term FROM v) WHERE v IN ({', '.join(map(lit, sorted(near)))}) AND length(term) >= {n}"
        if n >= 7:
            keys += f" UNION SELECT term FROM v WHERE starts_with(term, {lit(q)})"
        d = f"CASE WHEN starts_with(key, {lit(q)}) THEN 0 ELSE {up_to_one(q)} END"
        parts.append(f"SELECT {lit(q)} AS q, id, d FROM (SELECT DISTINCT key, {d} AS d FROM (SELECT term AS key, substr(term, 1, {n + 1}) AS t FROM ({keys}))) JOIN p ON p.term = key WHERE d <= 1")
    return " UNION ".join(parts)


def sound_search(query: str, mode: MatchMode) -> str:
    terms = sorted({k for w in query_terms(query) for k in keys_str(w)})
    return f"WITH p AS ({sound_posts(values(NAMES, 'id, text'))}), v AS (SELECT DISTINCT term FROM p) {combined(sound_hits(terms), terms, mode)}"


# --- the registry ---


def metaphone(rows: str) -> str:
    """term, key of the distinct words of rows (id, text): English ones letter by letter, Russian ones by each letter's neighbours."""
    drop, keep = "-", "="
    rules = [
        ("CK", drop), ("CIA", "X1"), ("C[IEY]", "S1"), ("SCH", "K1", ""), ("CH", "X1"), ("C", "K1"), ("DG[EYI]", "J1"), ("DG", keep), ("D", "T1"),
        ("GGH[AEIOU]$", keep, ""), ("GH", drop), ("(GGN..|[^G]GN.)", drop, ""), ("G.*NED$", drop), ("G[IEY]", "J1"), ("G", "K1"), ("[AEIOU]H([^AEIOU]|$)", drop, ""),
        ("PH", "F2"), ("Q", "K1"), ("(SH|SI[AO])", "X1"), ("TI[AO]", "X1"), ("[^T]TH", "O2", ""), ("TCH", drop), ("V", "F1"), ("X", "KS"), ("Y[AEIOU]", drop), ("Z", "S1"),
    ]
    case = " ".join(f"WHEN regexp_matches(b || r, '^{(*more, '.')[0]}{p}', 's') THEN '{what}'" for p, what, *more in rules)
    started = """CASE WHEN regexp_matches(t, '^(KN|GN|PN|AE|WR)') THEN substr(t, 2) WHEN regexp_matches(t, '^WH[AEIOU]') THEN 'W' || substr(t, 3) WHEN regexp_matches(t, '^WH') THEN substr(t, 3)
        WHEN t[1] = 'X' THEN 'S' || substr(t, 2) ELSE t END"""
    return f"""WITH RECURSIVE words AS MATERIALIZED (SELECT DISTINCT term FROM ({posts(rows)})),
        kinds AS (SELECT term, regexp_matches(term, '[\\x{{0400}}-\\x{{04ff}}]') AS ru, regexp_matches(term, '[\\x00-\\x2f\\x3a-\\x7f]') AS en FROM words),
        steps AS (
            SELECT term, '' AS o, regexp_replace({started}, 'MB$', 'M') AS r, ' ' AS b FROM (SELECT term, term AS t FROM kinds WHERE en AND NOT ru)
            UNION ALL
            SELECT term, o || e, CASE what WHEN '{keep}' THEN substr(s, 2) WHEN '{drop}' THEN substr(s, 3) WHEN 'KS' THEN 'S' || substr(s, 2) ELSE substr(s, 1 + what[2]::INT) END,
                   CASE WHEN e = '' THEN b ELSE e END
            FROM (SELECT *, CASE WHEN what = '{keep}' THEN s[1] WHEN what = '{drop}' THEN s[2] WHEN s = '' THEN '' ELSE what[1] END AS e
                  FROM (SELECT *, CASE {case} ELSE '{keep}' END AS what, CASE WHEN b = r[1] AND b <> 'C' THEN substr(r, 2) ELSE r END AS s FROM steps WHERE r <> ''))
        ),
        letters AS (SELECT term, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i, length(t) AS n FROM (SELECT term, regexp_replace(term, '[ЬЪ]', '', 'g') AS t FROM kinds WHERE ru AND NOT en)),
        ended AS (SELECT term, i, CASE WHEN i = n THEN translate(c, 'БВГДЗ', 'ПФКТC') ELSE c END AS c FROM letters),
        once AS (SELECT * FROM (SELECT *, lag(c) OVER (PARTITION BY term ORDER BY i) AS p FROM ended) WHERE c IS DISTINCT FROM p),
        near AS (SELECT term, i, c, coalesce(lag(c) OVER (PARTITION BY term ORDER BY i), '') AS p, coalesce(lead(c) OVER (PARTITION BY term ORDER BY i), '') AS f FROM once),
        ru AS (SELECT term, string_agg(CASE WHEN c IN ('О', 'Е') AND p IN ('Й', 'И') THEN '' WHEN c = 'Й' AND f IN ('О', 'Е') THEN 'И' WHEN c IN ('Д', 'Т') AND f = 'С' THEN 'Ц'
            WHEN f <> '' AND contains('ТСВКДПГЗБЧХЖШЦЩФ', f) THEN translate(c, 'БВГДЗЕЁЭОЫЯЮ', 'ПФКТCИИИАААУ') ELSE translate(c, 'ЕЁЭОЫЯЮ', 'ИИИАААУ') END, '' ORDER BY i) AS key FROM near GROUP BY term)
        SELECT term, o AS key FROM steps WHERE r = '' UNION ALL SELECT term, key FROM ru UNION ALL SELECT term, '' FROM kinds WHERE ru = en"""


def _line_sql(columns: str, where: str = "") -> str:
    numbered = values([(k + 1, x) for k, x in enumerate(LINES)], "line_no, line")
    cut = f"SELECT line_no, line, strpos(line, ';') AS cut FROM ({numbered})"
    sides = f"SELECT line_no, line, cut, trim(substr(line, 1, cut - 1)) AS name, trim(substr(line, cut + 1)) AS rest FROM ({cut})"
    parsed = f"SELECT *, CASE WHEN regexp_matches(name, '^[+-]?[0-9]+$') THEN try_cast(ltrim(name, '+') AS INT) END AS key FROM ({sides})"
    judged = f"""SELECT line_no, key AS id, rest AS text, CASE WHEN trim(line) = '' THEN 'InvalidSourceRecord'
        WHEN cut = 0 OR name = '' OR rest = '' THEN 'InvalidDelimitedSourceFormat' WHEN key IS NULL THEN 'InvalidIdFormat' END AS problem FROM ({parsed})"""
    return f"SELECT {columns} FROM ({judged}) {where}"


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, (of, query, location, mode) in EXACT.items():
        terms = list(query_terms(query))
        found[name] = search(source(of), exact_hits(terms, location), terms, mode)
    for name, (of, query, location, mode, misprints, precision, union) in NEAR.items():
        terms, options = list(query_terms(query)), Options(SearchType.NEAR, location, precision, misprints)
        found[name] = search(source(of), near_hits(terms, location, options, union), terms, mode)
    for name, (query, mode) in SOUND.items():
        found[name] = sound_search(query, mode)
    parts, people = posts(source(PARTS)), values(NAMES, "id, text")
    soft = lambda query: combined(exact_hits(list(query_terms(query)), Location.BEGIN_WORD), list(query_terms(query)), SOFT)
    joined = lambda ids: f"array_to_string(list_sort({ids}), ',')"
    named = f"SELECT text AS name, {sound('text')} AS key FROM ({people})"
    of = lambda *terms: " UNION ALL ".join(f"SELECT id FROM p WHERE term = {lit(t)}" for t in terms)
    found |= {
        "index_postings": posts(source(DOCS)),
        "index_term_stats": f"SELECT term, count(*) AS n_ids FROM ({posts(source(DOCS))}) GROUP BY term",
        "index_lists": f"SELECT term, {joined('list(id)')} AS ids FROM ({parts}) GROUP BY term",
        "custom_delimiters": posts(source(PARTS), "ei "),
        "number_search": search(source(CUSTOMERS), exact_hits(["CUSTOMER#00000001"], Location.BEGIN_WORD), ["CUSTOMER#00000001"], MatchMode.ALL_TERMS, numbers=True),
        "no_number_search": f"""SELECT term, count(*) AS n_ids FROM ({posts("SELECT c_custkey AS id, 'Name ' || c_name AS text FROM customer")}) GROUP BY term""",
        "delimited_source": "WITH line AS (SELECT p_partkey || ';' || p_name AS line FROM part), "
        + search("SELECT try_cast(trim(substr(line, 1, strpos(line, ';') - 1)) AS BIGINT) AS id, trim(substr(line, strpos(line, ';') + 1)) AS text FROM line", exact_hits(["RED"], Location.BEGIN_WORD), ["RED"], MatchMode.ALL_TERMS)[5:],
        "delimited_parse": _line_sql("line_no, coalesce(id::VARCHAR, '') AS id, coalesce(text, '') AS text, coalesce(problem, '') AS problem"),
        "delimited_lenient": _line_sql("id, text", "WHERE problem IS NULL"),
        "keyboard_distance": f"SELECT t AS term, d FROM ({dynamic('WIDGTE', f'SELECT DISTINCT term AS t FROM ({parts}) WHERE length(term) = 6')})",
        "phonetic_keys": f"""SELECT id, CASE WHEN regexp_matches(text, '^[A-Za-z]+$') THEN 'Unknown' ELSE 'RussianCyrillic' END AS language,
            {sound('text', False)} AS strict, {sound('text')} AS approx FROM ({people}) WHERE id NOT IN (14, 17)""",
        "phonetic_index": sound_posts(people),
        "phonetic_latin": latin_names(),
        "metaphone": metaphone(source(PARTS)),
        "metaphone_names": metaphone(values(NAMES + LATIN_NAMES, "id, text")),
        "metaphone_documents": metaphone(source(DOCS)),
        "deletion_index": f"""WITH v AS (SELECT DISTINCT term FROM ({parts}))
            SELECT substr(term, 1, i - 1) || substr(term, i + 1) AS variant, term AS key FROM (SELECT term, unnest(range(1, length(term) + 1)) AS i FROM v) UNION SELECT term, term FROM v""",
        "key_distribution": f"""WITH n AS ({named}), b AS (SELECT key, count(*) AS n FROM n WHERE key <> '' GROUP BY key)
            SELECT s.*, s.source - s.encoded AS skipped, b.*, b.links / b.unique_keys AS avg_bucket, b.unique_keys / s.source AS ratio
            FROM (SELECT count(*) AS source, count(*) FILTER (key <> '') AS encoded FROM n) s,
                 (SELECT count(*) AS unique_keys, sum(n)::BIGINT AS links, max(n) AS max_bucket, count(*) FILTER (n > 1) AS over_1, count(*) FILTER (n > 5) AS over_5, count(*) FILTER (n > 10) AS over_10 FROM b) b""",
        "largest_buckets": f"""SELECT key, count(*) AS n, array_to_string(list(name ORDER BY name)[1:10], ',') AS names
            FROM ({named}) WHERE key <> '' GROUP BY key ORDER BY n DESC, key LIMIT 15""",
        "set_union": f"WITH p AS ({parts}) SELECT DISTINCT id FROM ({of('RED', 'BOLT', 'RING')})",
        "set_intersect": f"WITH p AS ({parts}) ({of('RED')}) INTERSECT ({of('BOLT')})",
        "set_missing": f"WITH p AS ({parts}) SELECT id, (3 - count(*))::INT AS missing FROM ({of('RED', 'BOLT', 'SMALL')}) GROUP BY id",
        "set_arrays": f"""WITH p AS ({parts}), l AS (SELECT list(id) FILTER (term = 'RED') AS a, list(id) FILTER (term = 'BOLT') AS b FROM p)
            SELECT {joined('list_intersect(a, b)')} AS narrowed, {joined('b')} AS taken, {joined('list_intersect(a, list_concat(b, a))')} AS to_any,
                   {joined('list_append(a, -1)')} AS added, list_has_any(a, b) AS overlaps FROM l""",
        "bucketised": f"WITH p AS ({parts}) SELECT score, {joined('list(id)')} AS ids FROM ({soft('small red widget')}) GROUP BY score",
        "find_batch": f"WITH p AS ({parts}) " + " UNION ALL ".join(f"SELECT {lit(k)} AS query_id, score, id FROM ({soft(q)})" for k, q in BATCH.items()),
    }
    return found
