"""SQL for DuckDB of those queries whose results SQL can express over whole tables."""

from __future__ import annotations

_LOW = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(table: str, key: str, text: str, pattern: str) -> str:
    """r (a number of the row), key, w (the row's words)."""
    return f"SELECT row_number() OVER () AS r, {key}, regexp_extract_all(coalesce({text}, ''), '{pattern}') AS w FROM {table}"


def _runs(words: str, sizes: list[int]) -> str:
    """r, pos and for each size k a column p<k>: the k words from pos on, joined by a space; null where fewer are left."""
    sql = f"SELECT r, unnest(w) AS p1, generate_subscripts(w, 1) AS pos FROM {words}"
    n = 1
    while 2 * n <= max(sizes):
        sql = f"SELECT *, p{n} || ' ' || lead(p{n}, {n}) OVER (PARTITION BY r ORDER BY pos) AS p{2 * n} FROM ({sql})"
        n *= 2
    columns = []
    for k in sizes:
        parts, at = [], 0
        for n in (1 << b for b in reversed(range(k.bit_length())) if k >> b & 1):
            parts.append(f"lead(p{n}, {at}) OVER o")
            at += n
        columns.append(f"{" || ' ' || ".join(parts)} AS run{k}")
    return f"SELECT r, pos, p1 AS word, {', '.join(columns)} FROM ({sql}) WINDOW o AS (PARTITION BY r ORDER BY pos)"


def substring_dedup(window: int = 35) -> str:
    return f"""WITH d AS ({_words("documents", "doc_id", "text", "[^\\x20\\x09-\\x0D]+")}), runs AS ({_runs("d", [window])}),
        again AS (SELECT run{window} FROM runs WHERE run{window} IS NOT NULL GROUP BY run{window} HAVING count(*) > 1),
        gone AS (SELECT DISTINCT r, unnest(range(pos, pos + {window})) AS pos FROM runs JOIN again USING (run{window})),
        kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS t FROM (SELECT r, pos, word FROM runs) ANTI JOIN gone USING (r, pos) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (r)"""


def decontaminate(window: int = 13, share: int = 20) -> str:
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    sizes = list(range(1, window + 1))
    found = lambda relation: " UNION ALL ".join(f"SELECT r, pos, {k} AS k, run{k} AS run FROM {relation} WHERE run{k} IS NOT NULL" for k in sizes)
    return f"""WITH d AS ({_words("documents", "doc_id", _LOW.format(x="text"), word)}), b AS ({_words("benchmark", "item_id", _LOW.format(x="text"), word)}),
        dr AS ({_runs("d", sizes)}), br AS ({_runs("b", sizes)}),
        item AS (SELECT DISTINCT item_id, k, run FROM ({found("br")}) JOIN b USING (r) WHERE k = least({window}, len(w)) AND item_id IS NOT NULL),
        hits AS (SELECT r, pos, k, item_id FROM ({found("dr")}) JOIN item USING (k, run)),
        words AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(pos, pos + k)) AS at FROM hits) GROUP BY r),
        items AS (SELECT r, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT r, item_id::VARCHAR AS name FROM hits) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
               coalesce(words.n, 0) > 0 AND {share} * coalesce(words.n, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""


def chat() -> str:
    """Texts get a backslash before each backslash and each control string; the rest of a turn's length is its role's."""
    count = lambda mark: f"(length(t) - length(replace(t, '{mark}', ''))) // {len(mark)}"
    escapes = " + ".join(map(count, ("\\", "<s>", "</s>", "[INST]", "[/INST]", "<<ROLE>>", "<</ROLE>>")))
    frame = "CASE role WHEN 'user' THEN 20 WHEN 'assistant' THEN 7 ELSE 24 + length(role) END"
    extra = ", ".join(f"(-7, {k}, '{role}', '</s>[INST] ok [/INST]')" for k, role in enumerate(("user", "assistant")))
    return f"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations UNION ALL VALUES {extra}),
        said AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, t) AS whole,
                 coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role, t) FILTER (role = 'assistant'), '') AS masked, sum(length(t) + {escapes} + {frame}) AS size
                 FROM turns GROUP BY conv_id)
        SELECT conv_id, n::BIGINT AS n_turns, sha256(whole) AS turns_sha256, length(masked)::BIGINT AS loss_chars, sha256(masked) AS loss_sha256, size::BIGINT AS formatted_chars
        FROM said"""


def oracle_sql() -> dict[str, str]:
    return {"op4_rlz": substring_dedup(), "op7_chat": chat(), "op10_decontaminate": decontaminate()}
