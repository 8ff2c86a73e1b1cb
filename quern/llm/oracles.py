"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP10 = rf"""WITH w AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
win AS (SELECT r, i, ws[i : i + 4] AS g FROM w, unnest(range(1, len(ws) - 3)) AS u(i)),
rep AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, range(5) AS x(k) GROUP BY r),
lines AS (SELECT r, l FROM w, unnest(string_split(t, chr(10))) AS u(l) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT l) AS d FROM lines GROUP BY r),
m AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_lines, coalesce(dup.d, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
 len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) AS n_adjacent, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS n_letters, length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_marks, len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z\x{{80}}-\x{{10FFFF}}]'))) AS n_alpha_words
 FROM w LEFT JOIN cov USING (r) LEFT JOIN dup USING (r)),
b AS (SELECT *, ((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT + 8 * (word_chars < 2 * n_words OR word_chars > 12 * n_words)::INT + 16 * (n_lines >= 4 AND 100 * n_dup_lines > 35 * n_lines)::INT
 + 32 * (4 * n_adjacent > n_words)::INT + 64 * (n_letters >= 40 AND 2 * n_upper > n_letters)::INT + 128 * (2 * n_marks > n_words)::INT + 256 * (10 * n_alpha_words < 6 * n_words)::INT)::INT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM b"""

OP5 = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN ws ELSE ws[i : i + 3] END AS g FROM w, unnest(range(1, greatest(len(ws) - 2, 2))) AS u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON x.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.m AS component_id, r.m = d.doc_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) r USING (doc_id)"""

_BITS = OP10.rsplit("SELECT doc_id", 1)[0]
_RULES = "(VALUES ('few_words', 1), ('repeats', 2), ('symbols', 4), ('word_length', 8), ('dup_lines', 16), ('adjacent', 32), ('shouting', 64), ('marks', 128), ('alpha_words', 256)) AS r(rule, bit)"
ABLATION = _BITS + f"SELECT rule, count(*) FILTER (failed_bits & bit <> 0) AS failed, count(*) FILTER (failed_bits = bit) AS failed_alone, count(*) FILTER (failed_bits & (511 - bit) <> 0) AS rejected_without FROM b, {_RULES} GROUP BY rule"
POLICIES = _BITS + "SELECT policy, failed_bits & mask = 0 AS kept, count(*) AS n FROM b, (VALUES ('base', 3), ('v1', 511)) AS p(policy, mask) GROUP BY ALL"

ORACLES = {"quality_ablation": ABLATION, "quality_policies": POLICIES, "op5_hyperminhash": OP5, "op10_rule_ledger": OP10}
