"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from hearth.llm import contamination, licenses, phrases, quality, urls, warc

_WS = r"\x20\x09-\x0D"


def quality_sql() -> str:
    """Statistics, votes, EM unrolled over its iterations, posterior."""
    rules = quality.RULES
    k = len(rules)

    def total(names: tuple[str, ...]) -> str:
        return "CAST(" + " + ".join(names) + " AS DOUBLE)"

    def vote(r: quality.Rule) -> str:
        x = f"({total(r.num)} / nullif({total(r.den)}, 0))"
        bad, good = (">=", "<=") if r.good < r.bad else ("<=", ">=")
        return f"CASE WHEN {x} {bad} {r.bad!r} THEN 0 WHEN {x} {good} {r.good!r} THEN 1 ELSE 2 END"

    def odds(p: str) -> str:
        return f"ln({p}.good / (1 - {p}.good)) + " + " + ".join(
            f"CASE v{j} WHEN 0 THEN ln({p}.b{j} / {p}.a{j}) WHEN 1 THEN ln((1 - {p}.b{j}) / (1 - {p}.a{j})) ELSE 0 END"
            for j in range(k))

    start = ", ".join([f"CAST({quality.START_GOOD!r} AS DOUBLE) AS good",
                       *[f"CAST({quality.START_BAD_IF_BAD!r} AS DOUBLE) AS a{j}, "
                         f"CAST({quality.START_BAD_IF_GOOD!r} AS DOUBLE) AS b{j}" for j in range(k)]])
    prior, lo, cap = quality.PRIOR_VOTES, quality.LEAST, quality.MAX_FALSE_ALARM
    step = ", ".join(
        [f"greatest({lo!r}, least({1 - lo!r}, sum(n * p) / sum(n))) AS good"]
        + [f"greatest({2 * cap!r}, least({1 - lo!r}, (sum(CASE WHEN v{j} = 0 THEN n * (1 - p) ELSE 0 END)"
           f" + {prior * quality.START_BAD_IF_BAD!r}) / (sum(CASE WHEN v{j} <> 2 THEN n * (1 - p) ELSE 0 END) + {prior!r})"
           f")) AS a{j}, greatest({lo!r}, least({cap!r}, (sum(CASE WHEN v{j} = 0 THEN n * p ELSE 0 END)"
           f" + {prior * quality.START_BAD_IF_GOOD!r}) / (sum(CASE WHEN v{j} <> 2 THEN n * p ELSE 0 END) + {prior!r})"
           f")) AS b{j}" for j in range(k)])
    votes = ", ".join(f"v{j}" for j in range(k))
    steps = ",\n".join(
        f"m{i + 1} AS MATERIALIZED (SELECT {step} FROM (SELECT pat.*, 1 / (1 + exp(-({odds(f'm{i}')}))) AS p"
        f" FROM pat, m{i}))" for i in range(quality.ITERATIONS))
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
l AS MATERIALIZED (SELECT rid, doc_id, t, regexp_extract_all(t, '[^{_WS}]+') AS words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_WS}]')) AS lines FROM d),
w AS (SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM l),
t3 AS (SELECT rid, i, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
seen AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w, w1, w2) AS c FROM t3 WHERE w2 IS NOT NULL),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM seen, (VALUES (0), (1), (2)) AS s(k) WHERE c > 1 GROUP BY rid),
s AS MATERIALIZED (SELECT l.rid, doc_id, CAST(len(words) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[{_WS}]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
  len(list_distinct(words)) AS n_distinct_words,
  length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
  length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) AS n_lower,
  length(t) - length(regexp_replace(t, '!', '', 'g')) AS n_exclaims,
  length(t) - length(regexp_replace(t, '[\x00-\x08\x0E-\x1F!-/:-@\[-`{{-\x7F]', '', 'g')) AS n_ascii_other,
  len(regexp_extract_all(t, '[.!?](?:[{_WS}]|$)')) AS n_sentence_ends
  FROM l LEFT JOIN rep USING (rid)),
v AS MATERIALIZED (SELECT *, {", ".join(f"{vote(r)} AS v{j}" for j, r in enumerate(rules))} FROM s),
pat AS MATERIALIZED (SELECT {votes}, count(*) AS n FROM v GROUP BY {votes}),
m0 AS MATERIALIZED (SELECT {start}),
{steps},
f AS (SELECT v.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  1 / (1 + exp(-({odds(f'm{quality.ITERATIONS}')}))) AS p FROM v, m{quality.ITERATIONS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  round(p, 6) AS posterior, NOT base_failed AND p >= 0.5 AS kept FROM f"""


def urls_sql() -> str:
    """Host rules, item sets of 1 to 3 tokens by self-joins, and the best mined rule."""
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v)
            for v, h, p in sorted(urls.HOST_RULES, key=lambda r: -len(r[1] + r[2]))]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits) + " END"
    return f"""
WITH a AS (SELECT row_number() OVER () AS rid, page_id,
  CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
b AS (SELECT rid, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT rid, page_id, coalesce(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM b),
k AS MATERIALIZED (SELECT *, {rule} AS rule, {verdict} AS known,
  list_distinct(list_filter(list_concat(list_transform(string_split(host, '.'), lambda x: 'h:' || x),
    list_transform(string_split(path, '/'), lambda x: 'p:' || regexp_replace(x, '[0-9]+', '#', 'g'))),
    lambda x: length(x) > 2)) AS tokens FROM c),
lab AS MATERIALIZED (SELECT rid, known, tokens FROM k WHERE known IS NOT NULL AND len(tokens) > 0),
i AS MATERIALIZED (SELECT rid, known, unnest(tokens) AS t FROM lab),
sets AS (SELECT rid, known, [t] AS items FROM i
  UNION ALL SELECT x.rid, x.known, [x.t, y.t] FROM i x JOIN i y ON x.rid = y.rid AND x.t < y.t
  UNION ALL SELECT x.rid, x.known, [x.t, y.t, z.t] FROM i x JOIN i y ON x.rid = y.rid AND x.t < y.t
    JOIN i z ON x.rid = z.rid AND y.t < z.t),
each AS (SELECT items, known, count(*) AS n FROM sets GROUP BY items, known),
rules AS MATERIALIZED (SELECT items, known, n / sum(n) OVER (PARTITION BY items) AS confidence,
  n / (SELECT count(*) FROM lab) AS support, n FROM each),
good AS MATERIALIZED (SELECT * FROM rules WHERE confidence >= {urls.MIN_CONFIDENCE}
  AND n >= ceil(CAST({urls.MIN_SUPPORT} AS DOUBLE) * (SELECT count(*) FROM lab))),
m AS (SELECT rid, items, good.known AS verdict, confidence, row_number() OVER (PARTITION BY rid ORDER BY
  round(confidence, 9) DESC, round(support, 9) DESC, good.known <> 'block', items) AS r
  FROM k JOIN good ON list_has_all(k.tokens, good.items) WHERE k.known IS NULL)
SELECT page_id, host, path, rule, coalesce(k.known, m.verdict, 'allow') AS verdict,
  array_to_string(m.items, ' ') AS mined_rule, round(m.confidence, 6) AS confidence
FROM k LEFT JOIN m ON k.rid = m.rid AND m.r = 1"""


def warc_sql() -> str:
    """The captures of every page, an as-of join and the header merge."""
    permitted = set(warc.PERMITTED)

    def merged(name: str) -> str:
        if name in permitted:
            return f"coalesce(v.{name.replace('-', '_')}, r.{name.replace('-', '_')})"
        return f"r.{name.replace('-', '_')}"

    names = ("cache-control", "content-length", "content-type", "date", "etag", "last-modified")
    headers = " || chr(10) || ".join(f"'{n}: ' || {merged(n)}" for n in names)
    return rf"""
WITH p AS (SELECT 8 * page_id + o AS id, html, 1700000000 + page_id * 600 AS base,
  CASE o WHEN 0 THEN url ELSE regexp_extract(url, '^[^:]*://[^/?#]*/[^/?#]*') END AS u,
  '"' || substr(md5(html), 1, 12) || '"' AS tag FROM pages, (VALUES (0), (4)) AS v(o)),
c AS (SELECT *, regexp_replace(substr(u, instr(u, '://') + 3), '#.*$', '') AS rest FROM p),
q AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), ':(80|443)$', ''), '^www\.', '')
  || substr(rest, length(regexp_extract(rest, '^[^/?]*')) + 1) AS key FROM c),
r AS (SELECT id AS response_id, key, base AS ts, 'max-age=60' AS cache_control,
  CAST(length(html) AS VARCHAR) AS content_length, 'text/html' AS content_type, CAST(base AS VARCHAR) AS date,
  tag AS etag, CAST(base AS VARCHAR) AS last_modified, sha256(html) AS payload_digest
  FROM q WHERE html IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key, base ORDER BY id DESC) = 1),
v AS (SELECT id + 1 AS record_id, key, base + 60 AS ts, 'max-age=600' AS cache_control,
    CAST(base + 60 AS VARCHAR) AS date, 'W/' || tag AS etag, NULL AS last_modified FROM q
  UNION ALL SELECT id + 2, key, base + 3000, NULL, CAST(base + 3000 AS VARCHAR), NULL, CAST(base AS VARCHAR) FROM q
  UNION ALL SELECT id + 3, key, base, NULL, NULL, tag, NULL FROM q),
j AS (SELECT v.record_id, r.response_id, r.payload_digest, {headers} AS headers,
  CASE WHEN r.response_id IS NULL THEN 'no_response'
    WHEN v.etag IS NOT NULL AND r.etag IS NOT NULL THEN
      CASE WHEN regexp_replace(v.etag, '^W/', '') = r.etag THEN 'resolved' ELSE 'changed' END
    WHEN v.last_modified IS NOT NULL THEN
      CASE WHEN v.last_modified = r.last_modified THEN 'resolved' ELSE 'changed' END
    ELSE 'no_validator' END AS outcome
  FROM v ASOF LEFT JOIN r ON v.key = r.key AND v.ts > r.ts)
SELECT record_id, outcome, response_id, CASE WHEN outcome = 'resolved' THEN headers END AS headers,
  CASE WHEN outcome = 'resolved' THEN payload_digest END AS payload_digest FROM j"""


def licenses_sql() -> str:
    """Sentences, table look-up, and ordered rules as one alternation over identifiers."""
    rules = licenses.RULES + licenses.SPDX_RULES
    known = ", ".join(f"('{s}', '{i}')" for i, s in licenses.SENTENCES + licenses.SPDX_SENTENCES)
    framed = "CASE " + " ".join(f"WHEN starts_with(n.s, '{head}') AND ends_with(n.s, '{tail}') THEN '{i}'"
                                for i, head, tail in licenses.FRAMED_SENTENCES) + " END"
    pattern = "|".join("".join(f"<{i}>" for i in ids) for _, ids in rules)
    names: dict[str, str] = {}
    for name, ids in rules:
        names.setdefault("".join(f"<{i}>" for i in ids), name)
    named = ", ".join(f"('{k}', '{v}')" for k, v in names.items())
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id,
  string_split(regexp_replace(coalesce(text, ''), '([.!?])[{_WS}]+', '\1' || chr(10), 'g'), chr(10)) AS parts FROM documents),
s AS (SELECT rid, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM d),
n AS (SELECT rid, i, trim(regexp_replace(lower(s), '[^0-9a-z]+', ' ', 'g')) AS s FROM s),
f AS (SELECT rid, i, coalesce(k.id, {framed}) AS id FROM n LEFT JOIN (VALUES {known}) AS k(s, id) ON n.s = k.s
  WHERE coalesce(k.id, {framed}) IS NOT NULL),
g AS (SELECT rid, string_agg(id, ' ' ORDER BY i) AS sentences, string_agg('<' || id || '>', '' ORDER BY i) AS seq FROM f GROUP BY rid),
m AS (SELECT rid, sentences, regexp_extract_all(seq, '{pattern}') AS hits FROM g),
h AS (SELECT rid, unnest(hits) AS hit, generate_subscripts(hits, 1) AS i FROM m),
o AS (SELECT rid, string_agg(r.name, ' ' ORDER BY i) AS licenses, min_by(r.name, i) AS license
  FROM h JOIN (VALUES {named}) AS r(hit, name) USING (hit) GROUP BY rid)
SELECT doc_id, coalesce(sentences, '') AS sentences, coalesce(licenses, '') AS licenses, license
FROM d LEFT JOIN m USING (rid) LEFT JOIN o USING (rid)"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def phrases_sql() -> str:
    """All phrases counted, all cuts, 128-bit arithmetic."""
    least, top = phrases.MIN_COUNT, phrases.TOP
    return rf"""
WITH p AS MATERIALIZED (SELECT lang, row_number() OVER () AS piece, words FROM (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM (
    SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
      '[.,;:!?\x0A-\x0D]')) AS piece FROM documents))),
w AS MATERIALIZED (SELECT lang, piece, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM p),
t AS (SELECT lang, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY piece ORDER BY i)),
f AS MATERIALIZED (SELECT lang, 1 AS k, w AS phrase, count(*) AS n FROM t GROUP BY ALL
  UNION ALL SELECT lang, 2, w || ' ' || w1, count(*) FROM t WHERE w1 IS NOT NULL GROUP BY ALL HAVING count(*) >= {least}
  UNION ALL SELECT lang, 3, w || ' ' || w1 || ' ' || w2, count(*) FROM t WHERE w2 IS NOT NULL GROUP BY ALL
    HAVING count(*) >= {least}),
n AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS x FROM f WHERE k > 1),
cut AS (SELECT c.*, j, array_to_string(x[1:j], ' ') AS first, array_to_string(x[j + 1:k], ' ') AS rest
  FROM c, (VALUES (1), (2)) AS s(j) WHERE j < k),
key AS MATERIALIZED (SELECT lang || chr(9) || phrase AS id, n FROM f),
s AS (SELECT lang, k, phrase, a, j, l.n AS l, r.n AS r, (1000000::HUGEINT * a * a) // (l.n::HUGEINT * r.n) AS score
  FROM cut JOIN key l ON l.id = lang || chr(9) || first JOIN key r ON r.id = lang || chr(9) || rest),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, phrase, max(a) AS longer FROM (
  SELECT lang, x[1] || ' ' || x[2] AS phrase, a FROM c WHERE k = 3
  UNION ALL SELECT lang, x[2] || ' ' || x[3], a FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
  CAST(n.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= {top}"""


def contamination_sql() -> str:
    """Every run of 1 to 10 document words against every window of the items."""
    k = contamination.WINDOW
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {words} AS words FROM documents),
i AS MATERIALIZED (SELECT row_number() OVER () AS seq, CAST(item_id AS VARCHAR) AS id, {words} AS words FROM benchmark),
iw AS (SELECT seq, id, least(len(words), {k}) AS k, unnest(words) AS w, generate_subscripts(words, 1) AS p FROM i),
il AS (SELECT id, k, list(w) OVER (PARTITION BY seq ORDER BY p ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING) AS l FROM iw),
win AS MATERIALIZED (SELECT DISTINCT id, k, array_to_string(l[1:k], ' ') AS t FROM il WHERE len(l) >= k),
dw AS (SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) AS p FROM d),
dl AS MATERIALIZED (SELECT rid, p,
  list(w) OVER (PARTITION BY rid ORDER BY p ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING) AS l FROM dw),
g AS (SELECT rid, p, k, array_to_string(l[1:k], ' ') AS t FROM dl, (SELECT DISTINCT k FROM win) WHERE len(l) >= k),
m AS MATERIALIZED (SELECT rid, p, win.k, id FROM g JOIN win ON g.k = win.k AND g.t = win.t),
h AS (SELECT rid, count(DISTINCT p + j) AS n FROM m, generate_series(0, {k - 1}) AS s(j) WHERE j < k GROUP BY rid),
t AS (SELECT rid, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT rid, id FROM m WHERE id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)"""
