"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from threadloom.llm import license_scan, quality_rules
from threadloom.llm.embedding_dedup import THRESHOLD

SPACES = r"[\x20\x09-\x0D]+"


def quality_rules_sql() -> str:
    q = quality_rules
    return rf"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACES}'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
  windows AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM docs)),
  twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
  covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY 1),
  texts AS (SELECT source, t, any_value(ls) AS ls, count(*) AS copies FROM docs GROUP BY 1, 2),
  lines AS (SELECT source, t, copies, lower(trim(regexp_replace(x, '{SPACES}', ' ', 'g'))) AS line FROM (SELECT source, t, copies, unnest(ls) AS x FROM texts)),
  hosts AS (SELECT source, greatest({q.MAX_LINE_DOCS}, pow(count(*), {q.MAX_LINE_POWER})) AS most FROM docs GROUP BY 1),
  held AS (SELECT source, t, copies, line, count(*) AS k FROM lines GROUP BY ALL),
  counts AS (SELECT source, line, sum(copies) AS n_docs FROM held GROUP BY 1, 2),
  gone AS (SELECT l.source, t, CAST(sum(k * len(string_split(l.line, ' '))) AS BIGINT) AS n FROM held l JOIN counts c ON l.source IS NOT DISTINCT FROM c.source AND l.line = c.line
    JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source WHERE n_docs - copies + 1 > most GROUP BY 1, 2),
  base AS (SELECT doc_id, source, t, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words FROM docs LEFT JOIN covered USING (doc_id)),
  failed AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words - coalesce(g.n, 0) >= {q.MIN_LEFT_SHARE} * n_words AS kept, coalesce(g.n, 0) AS removed_words
FROM failed f LEFT JOIN gone g ON f.source IS NOT DISTINCT FROM g.source AND f.t = g.t"""


def license_scan_sql() -> str:
    q = license_scan
    rows = ", ".join(f"({i}, '{family}', '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (family, name, text) in enumerate(q.TEMPLATES))
    words = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    return f"""
WITH known AS (SELECT *, CASE WHEN len(w) >= {q.SHORT} THEN {q.SHINGLE} ELSE least({q.SHORT_SHINGLE}, len(w)) END AS k FROM (SELECT template, family, license, {words} AS w FROM (VALUES {rows}) AS v(template, family, license, text))),
  theirs AS (SELECT *, CAST(pow(2, ceil(log2(places))) AS BIGINT) AS half FROM (SELECT template, family, license, k, len(w) - k + 1 AS places, unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))) AS g FROM known)),
  sizes AS (SELECT template, count(*) AS n FROM theirs GROUP BY 1),
  docs AS (SELECT doc_id, {words} AS w FROM documents),
  ours AS (SELECT doc_id, k, i - 1 AS p, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM known))),
  hits AS (SELECT doc_id, template, family, license, half, p, g FROM ours JOIN theirs USING (k, g)),
  placed AS (SELECT *, unnest([p // half, p // half - 1]) AS win FROM hits),
  scored AS (SELECT doc_id, family, license, half, count(DISTINCT g) / any_value(n) AS c, min(p) AS p FROM placed JOIN sizes USING (template) WHERE win >= 0 GROUP BY doc_id, template, family, license, half, win),
  best AS (SELECT doc_id, family, license, max(c) AS c, arg_min(p, (-c, p, half)) AS p, arg_min(half, (-c, p, half)) AS half FROM scored WHERE c >= {q.MIN_CONTAINMENT} GROUP BY 1, 2, 3)
SELECT doc_id, license, c AS containment, CAST(p AS BIGINT) AS position FROM best x
WHERE NOT EXISTS (SELECT 1 FROM best y WHERE y.doc_id IS NOT DISTINCT FROM x.doc_id AND y.family = x.family AND y.c > x.c AND abs(y.p - x.p) < 2 * x.half)"""


def embedding_dedup_sql() -> str:
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
  reach(vec_id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.vec_id, pairs.b FROM reach JOIN pairs ON reach.r = pairs.a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY 1) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM pairs GROUP BY 1) USING (vec_id)"""


def source_audit_sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    share = lambda n, total: f"CAST(1 + (1000000000::HUGEINT * ({n} + 5)) // ({total} + 5 * v) AS BIGINT)"
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
  sources AS (SELECT DISTINCT lang, source FROM docs),
  found AS (SELECT r, lang, source, translate(x, '{upper}', '{upper.lower()}') AS term FROM (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS x FROM docs)),
  kept AS (SELECT lang, term, count(*) AS lang_n FROM found GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
  langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY 1),
  own AS (SELECT lang, source, term, count(*) AS n FROM found JOIN kept USING (lang, term) GROUP BY ALL),
  grid AS (SELECT s.lang, s.source, k.term, coalesce(n, 0) AS n, lang_n, v, lang_total, sum(coalesce(n, 0)) OVER (PARTITION BY s.lang, s.source) AS total
    FROM sources s JOIN kept k USING (lang) JOIN langs USING (lang) LEFT JOIN own o ON o.lang = s.lang AND o.source = s.source AND o.term = k.term),
  shares AS (SELECT lang, source, term, n, {share("n", "total")} AS p, {share("lang_n", "lang_total")} AS q FROM grid),
  sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
  terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q),
  ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50"""


def fill_middle_sql() -> str:
    return r"""
WITH cut AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
  drawn AS (SELECT *, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(s, i, 8) AS BIGINT)) AS h, len(u) AS n FROM cut),
  formed AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
    least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b FROM drawn),
  parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS z FROM formed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || z || '<M>' || m WHEN 'spm' THEN '<S>' || z || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(p || m || z) AS restored_sha256 FROM parts"""


ORACLES = {"op2_license_scan": license_scan_sql(), "op9_quality_rules": quality_rules_sql(), "op10_embedding_dedup": embedding_dedup_sql(), "op11_source_audit": source_audit_sql(), "op13_fill_middle": fill_middle_sql()}
