"""DuckDB SQL for the rows of this subpackage's queries, where SQL can express them."""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]"
_SOLID = r"[^\x20\x09-\x0D]"

LINE_FREQUENCY = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_SOLID}+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_SOLID}')) AS ls FROM d),
windows AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) u(i)),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(3) r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, source, trim(regexp_replace(regexp_replace(lower(x), '{_SPACE}+', ' ', 'g'), '[0-9]', '0', 'g')) AS line, len(regexp_extract_all(x, '{_SOLID}+')) AS n FROM w, unnest(ls) u(x)),
hosts AS (SELECT source, count(*) AS docs FROM d GROUP BY source),
often AS (SELECT l.source, line, min(doc_id) AS first_doc FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source GROUP BY l.source, line, docs HAVING count(DISTINCT doc_id) >= 20 AND count(DISTINCT doc_id) > 0.05 * docs),
cut AS (SELECT doc_id, sum(n)::BIGINT AS n FROM lines l JOIN often o ON l.source IS NOT DISTINCT FROM o.source AND l.line = o.line AND l.doc_id <> o.first_doc GROUP BY doc_id),
base AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(c.n, 0) AS n_cut_words FROM w LEFT JOIN repeated r USING (doc_id) LEFT JOIN cut c ON c.doc_id = w.doc_id),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_words - n_cut_words AS n_left FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (n_cut_words > 0 AND (n_left < 0.5 * n_words OR n_left < 50)) AS kept, n_cut_words FROM judged
"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

COLLOCATIONS = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM documents),
g AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM p, range(1, 4) t(m), unnest(range(1, len(ws) - m + 2)) u(i)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY lang, m, phrase),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND a >= 10),
longer AS (SELECT lang, array_to_string(ws[i:i + 1], ' ') AS phrase, max(a) AS most FROM c, range(1, 3) t(i) WHERE m = 3 GROUP BY 1, 2),
kept AS (SELECT c.* FROM c LEFT JOIN longer USING (lang, phrase) WHERE m = 3 OR most IS NULL OR 100 * most < 50 * a),
cuts AS (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS x, array_to_string(ws[k + 1:], ' ') AS y FROM kept, range(1, 3) t(k) WHERE k < m),
scored AS (SELECT cuts.lang, cuts.phrase, cuts.a, k, fx.a AS l, fy.a AS r, (1000000::HUGEINT * cuts.a * cuts.a // (fx.a::HUGEINT * fy.a))::BIGINT AS score FROM cuts JOIN f fx ON fx.lang = cuts.lang AND fx.phrase = x JOIN f fy ON fy.lang = cuts.lang AND fy.phrase = y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best JOIN totals USING (lang))
SELECT * FROM r WHERE rank <= 2000
"""

LEXICAL = rf"""
WITH t AS (SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}') AS ws FROM documents),
size AS (SELECT d, doc_id, len(ws)::BIGINT AS n FROM t WHERE len(ws) > 0),
facts AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nl FROM size),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM benchmark) GROUP BY item_id, term),
tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(ws) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY d, term),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), facts),
impact AS (SELECT d, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nd) // nl))) AS s FROM tf JOIN w USING (term) JOIN size USING (d), facts),
scored AS (SELECT item_id, d, any_value(doc_id) AS doc_id, sum(times * s)::BIGINT AS score FROM q JOIN impact USING (term) GROUP BY item_id, d),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 20
"""

ORACLES: dict[str, str] = {"op12_pair_bound_maxscore": LEXICAL, "op13_rabin_karp_collocations": COLLOCATIONS, "op8_line_frequency": LINE_FREQUENCY, "op9_histogram_top_k": TOP_K}
