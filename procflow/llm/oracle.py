"""DuckDB SQL with the rows of the registered queries, where SQL can express them."""

from __future__ import annotations

from procflow.llm.queries import SHARD_BYTES

# The white space of a line's ends, and the letters that are lowered.
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINE_DEDUP = f"""
WITH lines AS (
    SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
    SELECT doc_id, pos, line, translate(trim(line, {_SPACE}), '{_UPPER}', '{_LOWER}') AS key FROM lines
), owners AS (
    SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key
), judged AS (
    SELECT k.*, coalesce(owner < doc_id, false) AS gone FROM keyed k LEFT JOIN owners o ON k.key = o.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

SHARDING = f"""
WITH rows_ AS (
    SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, md5(coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents
), addressed AS (
    SELECT doc_id, n_bytes,
           lpad(bin(('0x' || h[1:8])::BIGINT), 32, '0') || lpad(bin(('0x' || h[9:16])::BIGINT), 32, '0') AS bits
    FROM rows_
), prefixes AS (
    SELECT doc_id, n_bytes, d, substr(bits, 1, d) AS prefix FROM addressed, (SELECT unnest(range(0, 49)) AS d)
), fits AS (
    SELECT prefix FROM prefixes GROUP BY prefix HAVING sum(n_bytes) <= {SHARD_BYTES} OR count(*) = 1
), best AS (
    SELECT doc_id, n_bytes, min(d) AS depth FROM prefixes WHERE prefix IN (SELECT prefix FROM fits) GROUP BY ALL
)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, substr(bits, 1, depth) AS shard, depth::INT AS depth
FROM best JOIN addressed USING (doc_id, n_bytes)
"""

# Words of the similarity operators, and of benchmark windows.
_WORD = r"[^\x20\x09-\x0D]+"
_BENCHMARK_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(pattern: str, lowered: bool) -> str:
    text = "coalesce(text, '')"
    text = f"translate({text}, '{_UPPER}', '{_LOWER}')" if lowered else text
    return f"regexp_extract_all({text}, '{pattern}')"


JACCARD_JOIN = f"""
WITH RECURSIVE split AS (
    SELECT doc_id, {_words(_WORD, True)} AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM split WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
    SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
    WHERE 100 * m >= 80 * (p.n + q.n - m)
), reached AS (
    SELECT x, y FROM links UNION SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y
), least AS (
    SELECT x, min(y) AS y FROM reached GROUP BY x
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(y, d.doc_id)) AS component_id
FROM split d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.x = d.doc_id
"""

DECONTAMINATE = f"""
WITH d AS (
    SELECT doc_id, {_words(_BENCHMARK_WORD, True)} AS w FROM documents
), b AS (
    SELECT item_id, {_words(_BENCHMARK_WORD, True)} AS w FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS k
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (
    SELECT DISTINCT n FROM windows
), places AS (
    SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)
), found AS (
    SELECT doc_id, p.n, i, item_id FROM places p JOIN windows w ON w.k = p.k AND w.n = p.n
), hit AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT doc_id, n, i FROM found)) GROUP BY 1
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY 1
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""

SUBSTRING_DEDUP = f"""
WITH d AS (
    SELECT doc_id, {_words(_WORD, False)} AS w FROM documents
), places AS (
    SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)
), owners AS (
    SELECT k, min(doc_id) AS owner FROM places GROUP BY k
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS place
    FROM (SELECT p.doc_id, i FROM places p JOIN owners o ON o.k = p.k WHERE owner < doc_id)
), words AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM d
), kept AS (
    SELECT w.doc_id, count(*) FILTER (g.place IS NOT NULL) AS n_removed,
           string_agg(word, ' ' ORDER BY w.place) FILTER (g.place IS NULL) AS kept
    FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.place = w.place GROUP BY w.doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

_PIECE_END = r"[.,;:!?\x0A-\x0D]"
_PHRASE_WORD = r"[^\x20\x09]+"

COLLOCATIONS = f"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_PIECE_END}')) AS piece
    FROM documents
), split AS (
    SELECT lang, regexp_extract_all(piece, '{_PHRASE_WORD}') AS w FROM pieces
), grams AS (
    SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
    FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM split, (SELECT unnest([1, 2, 3]) AS m))
), f AS MATERIALIZED (
    SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL
), totals AS (
    SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang
), candidates AS MATERIALIZED (
    SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND a >= 10
), dropped AS (
    SELECT DISTINCT c.lang, c.phrase
    FROM (SELECT lang, a, array_to_string(w[i:i + 1], ' ') AS phrase FROM (SELECT *, unnest([1, 2]) AS i FROM candidates WHERE m = 3)) longer
    JOIN candidates c ON c.lang = longer.lang AND c.phrase = longer.phrase AND c.m = 2
    WHERE 100 * longer.a >= 50 * c.a
), cuts AS (
    SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS p, array_to_string(w[k + 1:m], ' ') AS q
    FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates)
), scored AS (
    SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r,
           1000000::HUGEINT * c.a * c.a // (x.a::HUGEINT * y.a) AS score
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = p JOIN f y ON y.lang = c.lang AND y.phrase = q
), weakest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
    FROM weakest ANTI JOIN dropped USING (lang, phrase)
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

_ENTRIES, _ROUNDS = 16, 6


def _nearest(k: int) -> str:
    """The nearest entry of round k's codebook for every part: its squared distance times the entries, plus its index."""
    return f"""near{k} AS MATERIALIZED (
    SELECT r, p, min(d * {_ENTRIES} + e) AS best
    FROM (SELECT r, p, e, sum((x - c) * (x - c)) AS d FROM comps JOIN book{k} USING (p, j) GROUP BY r, p, e) GROUP BY r, p
)"""


def _moved(k: int) -> str:
    """The codebook after round k: floored means of the parts of each used entry."""
    return f"""book{k + 1} AS MATERIALIZED (
    SELECT b.p, b.e, b.j, coalesce((s - ((s % n) + n) % n) // n, c) AS c
    FROM book{k} b LEFT JOIN (
        SELECT p, best % {_ENTRIES} AS e, j, sum(x)::BIGINT AS s, count(*) AS n
        FROM comps JOIN near{k} USING (r, p) GROUP BY ALL
    ) m ON m.p = b.p AND m.e = b.e AND m.j = b.j
)"""


VECTOR_CODES = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, embedding, len(embedding) // 8 AS w
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), comps AS MATERIALIZED (
    SELECT r, (i // w)::INT AS p, (i % w)::INT AS j, floor(embedding[i + 1]::DOUBLE * 4096)::BIGINT AS x
    FROM (SELECT r, w, embedding, unnest(range(0, len(embedding))) AS i FROM kept)
), book0 AS MATERIALIZED (
    SELECT p, r AS e, j, x AS c FROM comps WHERE r < {_ENTRIES}
), {", ".join(f"{_nearest(k)}, {_moved(k)}" for k in range(_ROUNDS))}, {_nearest(_ROUNDS)}, coded AS (
    SELECT r, string_agg(printf('%02x', (best % {_ENTRIES})::INT), '' ORDER BY p) AS code, sum(best // {_ENTRIES})::BIGINT AS error
    FROM near{_ROUNDS} GROUP BY r
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, j)) FROM book{_ROUNDS}) AS codebooks_sha256
FROM kept JOIN coded USING (r)
"""

ORACLE: dict[str, str] = {
    "op1_line_dedup": LINE_DEDUP,
    "op3_sharding": SHARDING,
    "op5_jaccard_join": JACCARD_JOIN,
    "op7_decontaminate": DECONTAMINATE,
    "op9_substring_dedup": SUBSTRING_DEDUP,
    "op11_collocations": COLLOCATIONS,
    "op12_vector_codes": VECTOR_CODES,
}
