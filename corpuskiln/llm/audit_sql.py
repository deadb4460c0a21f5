"""DuckDB SQL for the rule, run and audit queries."""

from __future__ import annotations

from .host_rules import BASE, RULES

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def host_rules_sql() -> str:
    fails = ", ".join(f"count(*) FILTER (WHERE {said})::DOUBLE AS f_{r}" for r, said in RULES.items())
    sums = ", ".join(f"sum(f_{r}) AS f_{r}, sum(f_{r} * f_{r} / n) AS s_{r}" for r in RULES)
    mean = {r: f"(p.f_{r} / total)" for r in RULES}
    rho = {r: f"""least(0.999, greatest(1e-6, coalesce(CASE WHEN total - squares / total - (hosts - 1) > 1e-9 AND {m} > 0 AND {m} < 1
      THEN ((p.s_{r} - p.f_{r} * {m}) / ({m} * (1 - {m})) - (hosts - 1)) / (total - squares / total - (hosts - 1)) END, 0)))""" for r, m in mean.items()}
    rates = ", ".join(f"({mean[r]} * (1 / {rho[r]} - 1) + h.f_{r}) / ((1 / {rho[r]} - 1) + h.n) AS rate_{r}, {mean[r]} AS mean_{r}" for r in RULES)
    bad = " OR ".join(f"(rate_{r} >= 0.5 AND rate_{r} * (1 - mean_{r}) > 4 * mean_{r} * greatest(0, 1 - rate_{r}))" for r in RULES)
    return rf"""
WITH w AS (SELECT doc_id, source, {WORDS} AS ws, coalesce(text, '') AS t FROM documents),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM tri) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) v(o) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT w.doc_id, w.source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)),
h AS (SELECT source, count(*)::DOUBLE AS n, {fails} FROM c GROUP BY source),
p AS (SELECT sum(n) AS total, sum(n * n) AS squares, count(*)::DOUBLE AS hosts, {sums} FROM h),
r AS (SELECT h.source, {rates} FROM h, p),
v AS (SELECT source, round(greatest({", ".join(f"rate_{r}" for r in RULES)}), 6) AS host_rate, ({bad}) AS host_rejected FROM r)
SELECT c.doc_id, c.source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({" OR ".join(RULES[r] for r in BASE)}) AS base_failed, host_rate, host_rejected,
  NOT ({" OR ".join(RULES[r] for r in BASE)}) AND NOT host_rejected AS kept
FROM c JOIN v ON v.source IS NOT DISTINCT FROM c.source"""


#: crc32 of the decimal doc_id: for each byte an XOR and eight shifts, over a list of bytes and of -1 for a shift.
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1),
  lambda k: [ord(substr(doc_id::VARCHAR, k::INT, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END), 4294967295::BIGINT)"""

PERIODIC = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS ws, {CRC} AS h FROM documents),
e AS (SELECT *, len(ws) AS n, h // 10 AS g FROM d),
f AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM e),
s AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE ws END AS ws FROM f),
w AS (SELECT doc_id, n, unnest(ws) AS w, unnest(range(0, n)) AS i FROM s),
eq AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
isl AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM eq),
st AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM isl GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM st GROUP BY doc_id, start, length),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT w.doc_id, w.i FROM w JOIN runs r ON r.doc_id = w.doc_id AND w.i >= r.start + r.period AND w.i < r.start + r.length),
kept AS (SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.i) AS rest FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY w.doc_id)
SELECT documents.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
  sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(rest, '')) AS collapsed_sha256
FROM documents LEFT JOIN told USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)"""

AUDIT = rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, {WORDS} AS ws FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT + 4 * (100 * len(regexp_extract_all(x, '[A-Z]')) > 10 * length(x))::INT
    + 8 * regexp_matches(x, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY x))::INT AS mask
  FROM t LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f(k, name) AS (VALUES (1, 'A'), (2, 'B'), (4, 'C'), (8, 'D'), (16, 'E')),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS ks, a.name || b.name || c.name || d.name || e.name AS filter_order FROM f a, f b, f c, f d, f e WHERE a.k + b.k + c.k + d.k + e.k = 31
  AND len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT filter_order, step, ks[step] AS k, coalesce(list_sum(ks[:step - 1]), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step::INT AS step, k, coalesce(sum(n) FILTER (WHERE mask & (before | k) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & k > 0), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (WHERE mask & before > 0 AND mask & k > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE mask = k), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & k > 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & k > 0), 0)::BIGINT AS toxic_lost
  FROM s, c GROUP BY ALL)
SELECT * EXCLUDE (k), (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM r"""
