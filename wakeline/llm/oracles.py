"""What SQL says the registered queries return, where SQL can say it on whole tables."""

from __future__ import annotations

from .mixing import MAX_EPOCHS, SEED

_W = r"'[^\x20\x09-\x0D]+'"
_BLANK = r"'^[\x20\x09-\x0D]*$'"

_RULES = """
r AS (SELECT *, CAST(CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
  + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 8 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 16 ELSE 0 END + CASE WHEN n_upper > n_lower THEN 32 ELSE 0 END + CASE WHEN 10 * n_bangs > 3 * n_words THEN 64 ELSE 0 END AS BIGINT) AS failed FROM m)"""

OP2 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), ws AS (SELECT doc_id, unnest(regexp_extract_all(text, {_W})) AS w, generate_subscripts(regexp_extract_all(text, {_W}), 1) AS i FROM d),
v AS (SELECT doc_id, i, CASE WHEN lead(w, 4) OVER x IS NOT NULL THEN concat_ws(' ', w, lead(w, 1) OVER x, lead(w, 2) OVER x, lead(w, 3) OVER x, lead(w, 4) OVER x) END AS win FROM ws WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT doc_id, i, CASE WHEN win IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, win) > 1 THEN 1 ELSE 0 END AS again FROM v),
rep AS (SELECT doc_id, sum(c) AS n FROM (SELECT doc_id, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM n) GROUP BY doc_id),
ls AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE NOT regexp_matches(l, {_BLANK}) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(regexp_extract_all(text, {_W})) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper,
  length(text) - length(translate(text, 'abcdefghijklmnopqrstuvwxyz', '')) AS n_lower, length(text) - length(translate(text, '!', '')) AS n_bangs FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id LEFT JOIN ls ON ls.doc_id = d.doc_id),{_RULES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM r"""

OP3 = """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS h FROM l),
v AS (SELECT *, (h + 69069 * coalesce(lag(h, 1) OVER w, 0) + 475559467 * coalesce(lag(h, 2) OVER w, 0)) % 2147483647 % 3 = 0 AS even, lead(i, 1) OVER w AS i1, lead(i, 2) OVER w AS i2 FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT *, i1 IS NULL OR (i > 1 AND i2 IS NOT NULL AND even AND NOT lag(even) OVER (PARTITION BY doc_id ORDER BY i)) AS ends FROM v),
k AS (SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM e),
c AS (SELECT doc_id, k, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM k GROUP BY doc_id, k),
g AS (SELECT *, n > 1 AND regexp_matches(body, '[^\\x20\\x09-\\x0D]') AND row_number() OVER (PARTITION BY body ORDER BY doc_id, k) > 1 AS gone FROM c)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, count(*) AS n_chunks, count(*) FILTER (gone) AS n_chunks_removed, CAST(coalesce(sum(n) FILTER (gone), 0) AS BIGINT) AS n_lines_removed,
  sha256(coalesce(string_agg(body, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY doc_id"""

OP6 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), ws AS (SELECT doc_id, unnest(regexp_extract_all(text, {_W})) AS w, generate_subscripts(regexp_extract_all(text, {_W}), 1) AS i FROM d),
v AS (SELECT doc_id, i, w, CASE WHEN lead(i, 34) OVER (PARTITION BY doc_id ORDER BY i) IS NOT NULL THEN md5(string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) END AS win FROM ws),
n AS (SELECT doc_id, i, w, CASE WHEN win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 THEN 1 ELSE 0 END AS again FROM v),
g AS (SELECT doc_id, i, w, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM n)
SELECT d.doc_id, count(g.i) AS n_words, CAST(coalesce(sum(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(string_agg(w, ' ' ORDER BY i) FILTER (gone = 0), '')) AS kept_sha256 FROM d LEFT JOIN g ON g.doc_id = d.doc_id GROUP BY d.doc_id"""

OP7 = r"""WITH u AS (SELECT page_id, coalesce(url, '') AS u FROM pages), s AS (SELECT page_id, CASE WHEN strpos(u, '://') > 0 THEN substr(u, strpos(u, '://') + 3) ELSE '' END AS rest FROM u),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
r AS (SELECT * FROM (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')) r(rule, h, pre, verdict)),
b AS (SELECT p.page_id, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict FROM p JOIN r ON ends_with('.' || p.host, '.' || r.h) AND starts_with(p.path, r.pre) GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, CASE WHEN p.host LIKE '%casino%' OR p.path LIKE '%/wp-login%' OR p.path LIKE '%/cart/%' OR p.path LIKE '%.exe' OR p.path LIKE '%.zip' OR p.path LIKE '%/calendar/____-__%' THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN b ON b.page_id = p.page_id"""

OP9 = f"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_W})) AS BIGINT) AS size, length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>!', '')) AS symbols FROM documents),
k AS (SELECT *, -ln((CAST('0x' || substr(md5('{SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0) / CASE WHEN size + 20 * symbols > 0 THEN size / (size + 20 * symbols) ELSE 1e0 END AS key FROM d),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source), w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(source_size * {MAX_EPOCHS} AS DOUBLE) AS cap, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
c AS (SELECT *, row_number() OVER x AS nth, (sum(source_size) OVER () - (sum(cap) OVER (x ROWS UNBOUNDED PRECEDING) - cap)) / sum(weight) OVER (x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w WINDOW x AS (ORDER BY cap / weight, place)),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, least(cap, (SELECT arg_min(level, nth) FROM c WHERE level * weight <= cap) * weight) AS target FROM c),
f AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
j AS (SELECT k.*, f.source_size, f.target, f.epochs, CAST(floor(target) AS BIGINT) - epochs * f.source_size AS rest, sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size AS before FROM k JOIN f ON f.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM j"""

_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_TERM})"

OP13 = f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS ts FROM documents), n AS (SELECT k, doc_id, CAST(len(ts) AS BIGINT) AS n FROM d WHERE len(ts) > 0), s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY item_id, t),
p AS (SELECT k, t, count(*) AS tf FROM (SELECT k, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY k, t),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), s),
c AS (SELECT k, t, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)) AS c FROM p JOIN n USING (k), s),
r AS (SELECT item_id, k, CAST(sum(times * w * c) AS BIGINT) AS score FROM q JOIN w USING (t) JOIN c USING (t) GROUP BY item_id, k),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM r JOIN n USING (k) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 20"""

ORACLE_SQL: dict[str, str] = {"op2_quality_rules": OP2, "op3_line_dedup": OP3, "op6_substring_dedup": OP6, "op7_url_filter": OP7, "op9_source_mixing": OP9, "op13_lexical_search": OP13}
