"""DuckDB SQL for the numbered queries that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"

OP8 = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap,
    sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS budget FROM s),
o AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
l AS (SELECT arg_min((budget - before) / rest, cap / w) AS level FROM o WHERE (budget - before) / rest * w <= cap),
t AS (SELECT source, source_size, least(cap, coalesce(level, 0) * w)::DOUBLE AS target FROM w, l),
c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS goal, greatest(t.source_size, 1) AS whole,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (goal // whole * size + greatest(0, least(size, goal % whole - before)))::BIGINT AS taken FROM c
"""

def op9() -> str:
    """Signals by list functions and windows; cutoffs by the binomial distribution through lgamma."""
    from .quality import GRID

    tests = sum(map(len, GRID.values()))
    counts = ", ".join(f"sum(({s} > {c!r}::DOUBLE)::INT)::BIGINT AS k_{s}_{i}" for s, cuts in GRID.items() for i, c in enumerate(cuts))
    arms = " UNION ALL ".join(f"SELECT stratum, n, strata, '{s}' AS signal, {c!r}::DOUBLE AS cut, k_{s}_{i} AS k FROM g" for s, cuts in GRID.items() for i, c in enumerate(cuts))
    above = " OR ".join(f"coalesce({s} > c_{s}, false)" for s in GRID)
    cuts = ", ".join(f"min(cut) FILTER (signal = '{s}' AND p <= 0.05 / (strata * {tests})) AS c_{s}" for s in GRID)
    p = 0.02 / len(GRID)
    return rf"""
WITH a AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
b AS (SELECT *, row_number() OVER () AS r, regexp_extract_all(t, '{WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM a),
u AS (SELECT r, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM b),
m AS (SELECT r, i, lead(x, 4) OVER o IS NOT NULL AS fits, concat_ws(' ', x, lead(x) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS five FROM u WINDOW o AS (PARTITION BY r ORDER BY i)),
v AS (SELECT r, i, count(*) OVER (PARTITION BY r, five) AS n FROM m WHERE fits),
x AS (SELECT r, least(5, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 5)) AS c FROM v WHERE n > 1),
y AS (SELECT r, sum(c)::BIGINT AS n FROM x GROUP BY r),
f AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(y.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda z: length(z) = 1)) AS lone, len(l) AS n_lines FROM b LEFT JOIN y USING (r)),
s AS (
  SELECT *, n_symbols / greatest(word_chars, 1) AS symbol_share, n_dup_lines / greatest(n_lines, 1) AS dup_line_share, n_repeat_words / greatest(n_words, 1) AS repeat_share,
    word_chars / greatest(n_words, 1) AS mean_word, lone / greatest(n_words, 1) AS lone_share FROM f),
q AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
g AS (SELECT stratum, count(*) AS n, count(*) OVER () AS strata, {counts} FROM s SEMI JOIN q USING (doc_id) GROUP BY stratum),
e AS ({arms}),
h AS (SELECT *, list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - (CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END) - lgamma(n - i + 1) + i * ln({p!r}) + (n - i) * ln(1 - {p!r})))) AS p FROM e),
c AS (SELECT stratum, {cuts} FROM h GROUP BY stratum),
o AS (SELECT s.*, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, ({above}) AS above FROM s LEFT JOIN c USING (stratum))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT above AS kept FROM o
"""


OP1 = rf"""
WITH l AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS l FROM documents),
w AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS x FROM l),
g AS (SELECT doc_id, i, count(*) OVER o AS n, md5(string_agg(x, ' ') OVER o) AS s FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS again FROM g WHERE n = 20),
c AS (SELECT w.doc_id, w.i, w.x, coalesce(bool_or(f.again) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone FROM w LEFT JOIN f ON w.doc_id = f.doc_id AND w.i = f.i),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(x, ' ' ORDER BY i) FILTER (NOT gone) AS t FROM c GROUP BY doc_id)
SELECT l.doc_id, len(l.l)::BIGINT AS n_words, coalesce(k.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM l LEFT JOIN k USING (doc_id)
"""

OP3 = rf"""
WITH RECURSIVE l AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS l FROM documents),
w AS (SELECT doc_id, len(l) AS n, generate_subscripts(l, 1) AS i, unnest(l) AS x FROM l),
g AS (SELECT doc_id, n, i, count(*) OVER o AS c, md5(string_agg(x, ' ') OVER o) AS s FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
t AS (SELECT DISTINCT doc_id, s FROM g WHERE c = 5 OR (n < 5 AND i = 1)),
z AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM t a JOIN t b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * p.n >= 85 * (x.n + y.n - p.n)),
sides AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS id, a AS nd FROM sides UNION SELECT r.id, sides.b FROM r JOIN sides ON r.nd = sides.a),
m AS (SELECT id, min(nd) AS c FROM r GROUP BY id)
SELECT l.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, coalesce(m.c, l.doc_id) AS component_id, coalesce(m.c, l.doc_id) = l.doc_id AS kept FROM l LEFT JOIN z USING (doc_id) LEFT JOIN m ON m.id = l.doc_id
"""

#: CRC-32 bit by bit; the lower-cased text; each tree by recursion over its levels; siblings and foldings by level.
OP13 = r"""
WITH RECURSIVE d AS (
  SELECT *, text AS own, doc_id::VARCHAR AS i, coalesce(xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END, xor(c, b)), 4294967295::BIGINT), 4294967295::BIGINT) % 3 = 0, false) AS hit FROM documents),
h AS (SELECT *, CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS said FROM d),
f AS (
  SELECT doc_id, lang, concat(coalesce(strlen(i) || ':' || i, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-')) AS head,
    coalesce(strlen(text) || ':' || text, '-') AS own, coalesce(strlen(said) || ':' || said, '-') AS said FROM h),
l AS (SELECT doc_id, lang, sha256(head || own) AS leaf, sha256(head || said) AS claimed FROM f),
g AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS size FROM l),
n AS (
  SELECT tree, 0 AS level, pos, leaf AS h, size FROM g UNION ALL
  SELECT tree, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), any_value((size + 7) // 8) FROM n WHERE size > 1 GROUP BY tree, level, pos // 8),
s AS (SELECT tree, h AS subroot FROM n WHERE size = 1),
t AS (
  SELECT 0 AS level, tree - 1 AS pos, subroot AS h, count(*) OVER () AS size FROM s UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), any_value((size + 7) // 8) FROM t WHERE size > 1 GROUP BY level, pos // 8),
a AS (SELECT tree, level, pos, size FROM n WHERE size > 1),
b AS (
  SELECT a.tree, a.level, a.pos, coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos < a.pos), '') AS l, coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos > a.pos), '') AS r
  FROM a JOIN n ON n.tree = a.tree AND n.level = a.level AND n.pos // 8 = a.pos // 8 GROUP BY a.tree, a.level, a.pos),
c AS (
  SELECT a.level, a.pos, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < a.pos), '') AS l, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > a.pos), '') AS r
  FROM (SELECT * FROM t WHERE size > 1) a JOIN t ON t.level = a.level AND t.pos // 8 = a.pos // 8 GROUP BY a.level, a.pos),
o AS (
  SELECT tree, pos AS leaf_pos, 0 AS level, pos, claimed AS node, '' AS beside FROM g UNION ALL
  SELECT o.tree, leaf_pos, o.level + 1, o.pos // 8, sha256(b.l || node || b.r), beside || b.l || b.r FROM o JOIN b ON b.tree = o.tree AND b.level = o.level AND b.pos = o.pos),
p AS (SELECT tree, leaf_pos, arg_max(node, level) AS node, arg_max(beside, level) AS beside FROM o GROUP BY tree, leaf_pos),
q AS (
  SELECT tree, leaf_pos, 0 AS level, tree - 1 AS pos, node, beside FROM p UNION ALL
  SELECT tree, leaf_pos, q.level + 1, q.pos // 8, sha256(c.l || node || c.r), beside || c.l || c.r FROM q JOIN c ON c.level = q.level AND c.pos = q.pos),
z AS (SELECT tree, leaf_pos, arg_max(node, level) AS node, arg_max(beside, level) AS beside FROM q GROUP BY tree, leaf_pos)
SELECT doc_id, leaf, subroot, root, sha256(beside) AS proof_sha256, node AS folded_root, node = root AS verified
FROM g JOIN s USING (tree) JOIN z ON z.tree = g.tree AND z.leaf_pos = g.pos, (SELECT h AS root FROM t WHERE size = 1)
"""

ORACLES: dict[str, str] = {
    "op1_rlz_dedup": OP1,
    "op3_minhash": OP3,
    "op9_quality_rules": op9(),
    "op8_mix_sources": OP8,
    "op13_merkle_manifest": OP13,
}
