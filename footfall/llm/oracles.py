"""The operators' queries in DuckDB's SQL, where SQL can state them."""

from __future__ import annotations

from . import licenses, rules, urls

TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

NEARDUP = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c WHERE 100 * i >= 75 * (na + nb - i)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT DISTINCT a AS doc_id, a AS r FROM u UNION SELECT reach.doc_id, u.b FROM reach JOIN u ON u.a = reach.r),
m AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY 1)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, coalesce(r, doc_id) AS component_id, coalesce(r, doc_id) = doc_id AS kept FROM s LEFT JOIN m USING (doc_id)
"""


def rules_sql() -> str:
    """The counts, the votes by the same conditions, and expectation-maximisation unrolled, one view per round."""
    names = list(rules.RULES)
    n = rf"""
    w AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
    g AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
    again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS c FROM g) WHERE c > 1),
    rep AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM again CROSS JOIN range(3) t(d) GROUP BY 1),
    f AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(translate(text, '{rules.SYMBOLS}', '')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
        length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS n_upper, length(text) - length(translate(text, '!', '')) AS n_bangs, length(text) - length(translate(text, '.', '')) AS n_stops
        FROM w LEFT JOIN rep USING (doc_id)),
    v AS (SELECT *, {', '.join(f"CAST(CASE WHEN n_words = 0 THEN {rules.ABSTAIN} WHEN {bad} THEN {rules.BAD} WHEN {rather} THEN {rules.RATHER_BAD} WHEN {good} THEN {rules.GOOD} ELSE {rules.ABSTAIN} END AS INT) AS {k}" for k, (bad, rather, good) in rules.RULES.items())} FROM f),
    pt AS (SELECT {', '.join(names)}, count(*)::DOUBLE AS n FROM v GROUP BY ALL)"""
    size, prior = len(names), rules.prior_model(len(names))
    listed = lambda xs: "[" + ", ".join(f"{x}::DOUBLE" for x in xs) + "]"
    views = [
        f"ix AS (SELECT c, j, v FROM range({size + 1}) a(c), range({size}) b(j), range(4) d(v))",
        f"m0 AS (SELECT {listed(prior.shares)} AS pi, {listed(x for a in prior.chances for b in a for x in b)} AS ch)",
        "pr AS (SELECT pi AS pi0, ch AS ch0 FROM m0)",
    ]
    product = " * ".join(["pi[c + 1]", *[f"ch[c * {4 * size} + {4 * j} + {k} + 1]" for j, k in enumerate(names)]])
    joint = f"list_transform(range({size + 1}), lambda c: {product})"
    for r in range(1, rules.ROUNDS + 1):
        views.append(f"j{r} AS (SELECT pt.*, {joint} AS x FROM pt CROSS JOIN m{r - 1})")
        each = " UNION ALL ".join(f"SELECT c, {j} AS j, {k} AS v, n * x[c + 1] / list_sum(x) AS w FROM j{r} CROSS JOIN range({size + 1}) t(c)" for j, k in enumerate(names))
        views.append(f"s{r} AS (SELECT c, j, v, coalesce(w, 0) AS w, sum(coalesce(w, 0)) OVER (PARTITION BY c, j) AS nc FROM ix LEFT JOIN (SELECT c, j, v, sum(w) AS w FROM ({each}) GROUP BY ALL) USING (c, j, v))")
        views.append(f"""m{r} AS (SELECT list((nc + {rules.PRIOR_TEXTS} * pi0[c + 1]) / ((SELECT sum(n) FROM pt) + {rules.PRIOR_TEXTS}) ORDER BY c) FILTER (j = 0 AND v = 0) AS pi,
            list((w + {rules.PRIOR_TEXTS} * ch0[c * {4 * size} + j * 4 + v + 1]) / (nc + {rules.PRIOR_TEXTS}) ORDER BY c, j, v) AS ch FROM s{r} CROSS JOIN pr)""")
    failed = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"
    return f"""WITH {n}, {', '.join(views)},
    fin AS (SELECT *, {joint} AS x FROM v CROSS JOIN m{rules.ROUNDS})
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed, NOT {failed} AND x[1] / list_sum(x) >= {rules.KEEP_AT} AS kept, {', '.join(names)} FROM fin"""


def licenses_sql() -> str:
    """The same normal form in another dialect, joined to the digests of the known texts."""

    def by_line(text: str) -> str:
        out = f"regexp_replace(lower({text}), '{licenses.COPYRIGHT_LINE}', ' ', 'g')"
        for one, other in licenses.SPELLINGS:
            out = f"regexp_replace({out}, '\\b{one.replace('.', chr(92) + '.')}\\b', '{other}', 'g')"
        return f"regexp_replace({out}, '{licenses.OTHER}', ' ', 'g')"

    one_line = lambda x: f"trim(regexp_replace({x}, '{licenses.SPACE}', ' ', 'g'))"
    known = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in licenses.KNOWN)
    return f"""WITH k AS (SELECT md5(form) AS digest, min(l) AS license FROM (SELECT l, {one_line(by_line('t'))} AS form FROM (VALUES {known}) k(l, t)) WHERE form <> '' GROUP BY 1),
    d AS (SELECT row_number() OVER () AS rn, doc_id, {by_line("coalesce(text, '')")} AS form FROM documents),
    ln AS (SELECT rn, trim(unnest(string_split(form, chr(10)))) AS x FROM d UNION SELECT rn, {one_line('x')} FROM (SELECT rn, unnest(string_split_regex(form, '{licenses.BLANK}')) AS x FROM d)),
    nt AS (SELECT rn, list_sort(list_distinct(list(license))) AS notices FROM (SELECT rn, md5(x) AS digest FROM ln) JOIN k USING (digest) GROUP BY rn)
    SELECT doc_id, digest, license, coalesce(array_to_string(notices, ','), '') AS notices FROM (SELECT rn, doc_id, md5({one_line('form')}) AS digest FROM d) LEFT JOIN k USING (digest) LEFT JOIN nt USING (rn)"""


def urls_sql() -> str:
    """Rules as one case, and the three walks side by side as one recursion. The node '*' holds the mass of a restart: what
    it sends to a seed, and to itself, is not damped."""
    case = lambda pick: "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{pick(v, h, p)}'"
        for v, h, p in sorted(urls.RULES, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]), reverse=True)) + " END"
    lower = lambda x: f"translate({x}, '{urls.UPPER}', '{urls.LOWER}')"
    d, link = urls.DAMPING, urls.LINK.replace("'", "''")
    scores = ", ".join(f"coalesce(sum(score) FILTER (kind = '{k}'), 0) AS {k}" for k in ("trust", "distrust", "reach"))
    return rf"""WITH RECURSIVE
    h AS (SELECT page_id, html, {lower('raw')} AS host, path FROM (SELECT page_id, html, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS raw, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)),
    r AS (SELECT *, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS ruled FROM h),
    lk AS (SELECT src, {lower('raw')} AS dst FROM (SELECT host AS src, unnest(list_distinct(regexp_extract_all(html, '{link}', 1))) AS raw FROM r WHERE host <> '' AND html IS NOT NULL)),
    hosts AS (SELECT host FROM r WHERE host <> '' UNION SELECT dst FROM lk WHERE src <> dst),
    lb AS (SELECT string_split(host, '.') AS l FROM hosts WHERE NOT regexp_matches(host, '^[0-9.]+(:[0-9]*)?$')),
    up AS (SELECT DISTINCT array_to_string(l[i:], '.') AS src, array_to_string(l[i + 1:], '.') AS dst FROM (SELECT l, unnest(range(1, len(l) - 1)) AS i FROM lb)),
    edges AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, 1.0::DOUBLE AS w FROM lk WHERE src <> dst UNION ALL SELECT src, dst, 1.0 FROM up UNION ALL SELECT dst, src, 1.0 FROM up) GROUP BY 1, 2),
    ways AS (SELECT 'trust' AS kind, src, dst, w FROM edges UNION ALL SELECT kind, dst, src, w FROM edges, (VALUES ('distrust'), ('reach')) k(kind)),
    seeds AS (SELECT kind, host, sum(CASE WHEN kind = 'reach' OR ruled = verdict THEN 1.0::DOUBLE ELSE 0 END) AS mass FROM r, (VALUES ('trust', 'allow'), ('distrust', 'block'), ('reach', '')) k(kind, verdict) WHERE host <> '' GROUP BY 1, 2),
    base AS (SELECT kind, host, mass / sum(mass) OVER (PARTITION BY kind) AS score FROM seeds WHERE mass > 0),
    step AS (SELECT kind, src, dst, {d} * w / sum(w) OVER (PARTITION BY kind, src) AS p FROM ways UNION ALL SELECT kind, '*', host, {1 - d} * score FROM base UNION ALL SELECT DISTINCT kind, '*', '*', 1.0 FROM base),
    walk AS (SELECT 0 AS i, kind, host, score FROM base UNION ALL SELECT DISTINCT 0, kind, '*', 1.0::DOUBLE FROM base UNION ALL
        (SELECT i + 1, walk.kind, dst, sum(score * p) FROM walk JOIN step ON walk.kind = step.kind AND src = host WHERE i < {urls.ROUNDS} GROUP BY 1, 2, 3)),
    sc AS (SELECT host, {scores} FROM walk WHERE i = {urls.ROUNDS} GROUP BY 1)
    SELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN distrust > {urls.RATIO} * trust AND distrust > {urls.LIFT} * reach THEN 'block' ELSE 'allow' END) AS verdict
    FROM r LEFT JOIN sc ON sc.host = r.host"""


#: Words of a text as the decontamination contract has them.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
DECONTAMINATION = rf"""
WITH b AS (SELECT item_id, list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS row, doc_id, list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM win),
p AS (SELECT row, i, size, array_to_string(w[i:i + size - 1], ' ') AS g FROM (SELECT row, w, unnest(range(1, len(w) + 1)) AS i FROM d) CROSS JOIN sizes WHERE i + size - 1 <= len(w)),
o AS (SELECT row, i, size, item_id FROM p JOIN win USING (size, g)),
h AS (SELECT row, count(DISTINCT k) AS n_hit FROM (SELECT row, unnest(range(i, i + size)) AS k FROM o) GROUP BY row),
n AS (SELECT row, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM o GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (row) LEFT JOIN n USING (row)
"""

#: The checksum by a table of 256 steps; the edits as (state, edits that end with a row's own, its symbol's group, state).
CONVERSATIONS = r"""
WITH RECURSIVE steps AS (SELECT list(list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
base AS (SELECT row_number() OVER () AS row, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
sums AS (SELECT base.*, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS f FROM base CROSS JOIN steps),
dam AS (SELECT row, conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM sums WHERE f <> 0),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, row, copy) AS nth,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, row, copy) AS pos, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM dam),
marked AS (SELECT conv_id, turn, role, text, pos, role[1:1] AS ini, CASE WHEN t = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen),
pairs AS (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY pos) AS prev FROM marked),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum((fault = 'blank')::INT) AS blank, sum((fault = 'duplicate')::INT) AS duplicate, sum((fault = 'truncated')::INT) AS truncated,
           sum((prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au'))::INT) AS illegal, max(pos) AS last FROM pairs GROUP BY conv_id),
ins(q, made, q2, added) AS (VALUES (0, '', 0, []), (1, '', 1, []), (2, '', 2, []), (3, '', 3, []), (0, 'I', 2, ['user:']), (1, 'I', 2, ['user:']), (3, 'I', 2, ['user:']), (2, 'I', 3, ['assistant:']), (0, 'II', 3, ['user:', 'assistant:']), (1, 'II', 3, ['user:', 'assistant:'])),
own(q, edit, ini, q2, becomes) AS (SELECT q, 'D', '*', q, '' FROM range(4) r(q) UNION ALL (VALUES (0, 'K', 's', 1, ''), (0, 'K', 'u', 2, ''), (1, 'K', 'u', 2, ''), (3, 'K', 'u', 2, ''), (2, 'K', 'a', 3, ''),
    (0, 'R', '*', 2, 'user'), (1, 'R', '*', 2, 'user'), (3, 'R', '*', 2, 'user'), (2, 'R', '*', 3, 'assistant'))),
moves AS (SELECT ins.q, ins.made || own.edit AS made, own.ini, own.edit, own.q2, added, becomes, 2 * length(ins.made) + CASE own.edit WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END AS cost FROM ins JOIN own ON own.q = ins.q2),
walk AS (SELECT DISTINCT conv_id, 0::BIGINT AS pos, 0 AS q, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines FROM marked
         UNION ALL SELECT conv_id, pos, q2, cost, audit, lines FROM (
            SELECT w.conv_id, m.pos, v.q2, w.cost + v.cost + CASE WHEN m.fault = 'truncated' AND v.edit <> 'D' THEN 1 ELSE 0 END AS cost, w.audit || v.made AS audit,
                list_concat(list_concat(w.lines, v.added), CASE v.edit WHEN 'D' THEN [] WHEN 'K' THEN [m.role || ':' || m.text] ELSE [v.becomes || ':' || m.text] END) AS lines,
                row_number() OVER (PARTITION BY w.conv_id, v.q2 ORDER BY w.cost + v.cost + CASE WHEN m.fault = 'truncated' AND v.edit <> 'D' THEN 1 ELSE 0 END, w.audit || v.made) AS rk
            FROM walk w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.pos = w.pos + 1 JOIN moves v ON v.q = w.q AND (v.ini = '*' OR v.ini = m.ini) AND (v.edit = 'D' OR m.fault NOT IN ('blank', 'duplicate'))) WHERE rk = 1),
ended AS (SELECT w.conv_id, w.cost + 2 * length(i.made) AS cost, w.audit || i.made AS audit, list_concat(w.lines, i.added) AS lines,
          row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + 2 * length(i.made), w.audit || i.made) AS rk
          FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.last = w.pos JOIN ins i ON i.q = w.q WHERE i.q2 IN (0, 3))
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
    coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN (SELECT * FROM ended WHERE rk = 1) e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""

PHRASES = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS ws FROM w CROSS JOIN range(1, 5) t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, ws, array_to_string(ws, ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND f >= 30),
inner_ AS (SELECT c.lang, array_to_string(c.ws[i:i + m - 1], ' ') AS phrase, max(f) AS holder FROM c CROSS JOIN range(2, 4) a(m) CROSS JOIN range(1, 4) b(i) WHERE m < k AND i + m - 1 <= k GROUP BY 1, 2),
kept AS (SELECT c.* FROM c LEFT JOIN inner_ USING (lang, phrase) WHERE holder IS NULL OR 100::HUGEINT * holder < 80::HUGEINT * f),
cuts AS (SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, i, (2000000::HUGEINT * c.f // (x.f::HUGEINT + y.f))::BIGINT AS score
         FROM (SELECT *, unnest(range(1, k)) AS i FROM kept) c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[:i], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[i + 1:], ' ')),
low AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) AS rk FROM cuts) WHERE rk = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
