"""SQL for the corpus queries that SQL can express, over whole tables."""

from __future__ import annotations

WORD = r"'[^\x20\x09-\x0D]+'"

OP4 = rf"""WITH d AS (SELECT row_number() OVER () r, doc_id, coalesce(text, '') text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, {WORD}) w, [x for x in string_split(text, chr(10)) if regexp_matches(x, {WORD})] l FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 1)) i, w FROM w), t AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) c FROM g),
c AS (SELECT r, count(DISTINCT p) n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) p FROM t WHERE c > 1) GROUP BY r),
m AS (SELECT doc_id, text, len(w) n_words, coalesce(list_sum([length(x) for x in w]), 0)::BIGINT word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) n_symbols, len(l) n_lines, len(l) - len(list_distinct(l)) n_dup_lines, coalesce(n_repeat_words, 0) n_repeat_words FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 10 * n_symbols > n_words OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines) OR word_chars < 2 * n_words OR word_chars > 20 * n_words
OR 2 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > word_chars OR 2 * (length(text) - length(replace(text, '!', ''))) > n_words OR 2 * length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) < word_chars) kept FROM b"""

OP8 = rf"""WITH d AS (SELECT row_number() OVER () r, doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) k, len(regexp_extract_all(coalesce(text, ''), {WORD})) size FROM documents),
s AS (SELECT source, sum(size)::BIGINT source_size FROM d GROUP BY source), n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) rk FROM s),
w AS (SELECT *, ((rk - 1) % 3 + 1)::DOUBLE weight, (3 * source_size)::DOUBLE cap, (sum(source_size) OVER ())::DOUBLE total FROM n),
o AS (SELECT *, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0e0) ow, total - coalesce(sum(cap) OVER b, 0e0) rest FROM w WINDOW b AS (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, rest / ow lev FROM o), fin AS (SELECT arg_min(lev, (cap / weight, rk)) FILTER (lev * weight <= cap) final FROM f),
t AS (SELECT rk, source, source_size, total, CASE WHEN final IS NULL THEN cap ELSE least(cap, final * weight) END target FROM f, fin),
p AS (SELECT *, greatest(ceil(source_size / greatest(1e0, least(4096e0, total / 65536))), 1)::BIGINT nb FROM t),
q AS (SELECT *, CASE WHEN source_size > 0 THEN target * nb / source_size ELSE 0e0 END want FROM p),
z AS (SELECT *, sum(want) OVER (ORDER BY rk ROWS UNBOUNDED PRECEDING) up FROM q), y AS (SELECT *, up - want lo, max(up) OVER () top FROM z),
i AS (SELECT i, ((i + 0.5e0) * 0.6180339887498949e0) % 1e0 * (SELECT max(up) FROM z) u FROM (SELECT unnest(range((SELECT ceil(max(up))::BIGINT FROM z))) i)),
a AS (SELECT rk, nb, row_number() OVER (PARTITION BY rk ORDER BY i) - 1 n FROM i JOIN y ON want > 0 AND u >= lo AND (u < up OR up >= top)),
uses AS (SELECT rk, n % nb b, count(*) k FROM a WHERE n < 3 * nb GROUP BY ALL),
e AS (SELECT u.rk, k, ((b::HUGEINT * source_size) // nb)::BIGINT s, (((b + 1)::HUGEINT * source_size) // nb)::BIGINT e FROM uses u JOIN y USING (rk)),
x AS (SELECT d.*, y.rk, y.source_size, y.target, coalesce(sum(size) OVER (PARTITION BY y.rk ORDER BY k, doc_id NULLS FIRST, size, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT st FROM d JOIN y ON d.source IS NOT DISTINCT FROM y.source),
h AS (SELECT x.r, sum(e.k * (least(x.st + x.size, e.e) - greatest(x.st, e.s)))::BIGINT taken FROM x JOIN e ON x.rk = e.rk AND x.st < e.e AND x.st + x.size > e.s GROUP BY x.r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) taken FROM x LEFT JOIN h USING (r)"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP9 = f"""WITH it AS (SELECT item_id, regexp_extract_all({_LOW}, {WORD}) w FROM benchmark WHERE item_id IS NOT NULL), iw AS (SELECT item_id, w, least(len(w), 5) n FROM it WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) k FROM iw)), c AS (SELECT item_id, count(*) need FROM i GROUP BY item_id),
dw AS (SELECT row_number() OVER () r, doc_id, regexp_extract_all({_LOW}, {WORD}) w FROM documents WHERE doc_id IS NOT NULL),
d AS (SELECT DISTINCT r, doc_id, n, array_to_string(w[k:k + n - 1], ' ') g FROM (SELECT r, doc_id, w, n, unnest(range(1, len(w) - n + 2)) k FROM dw, (SELECT DISTINCT n FROM iw))),
h AS (SELECT r, doc_id, item_id, count(*) got FROM d JOIN i USING (n, g) GROUP BY ALL)
SELECT doc_id, item_id, max(need) n_shingles, max(got) n_common, max(got) / max(need) containment FROM h JOIN c USING (item_id) WHERE got >= need * 0.8e0 - 1e-9 GROUP BY doc_id, item_id"""

_H = "('0x' || substr(h, {}, 8))::BIGINT"
OP11 = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) h FROM documents),
l AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') l FROM d), n AS (SELECT *, len(l) n FROM l),
c AS (SELECT *, least({_H.format(1)} % (n + 1), {_H.format(9)} % (n + 1)) a, greatest({_H.format(1)} % (n + 1), {_H.format(9)} % (n + 1)) b,
CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {_H.format(17)} % 100 >= 100 THEN 'plain' WHEN {_H.format(25)} % 100 < 50 THEN 'spm' ELSE 'psm' END form FROM n),
p AS (SELECT *, array_to_string(l[1:a], '') p, array_to_string(l[a + 1:b], '') m, array_to_string(l[b + 1:], '') s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) output_sha256, sha256(text) restored_sha256 FROM p"""


def op13(urls) -> str:
    """Every term by a pattern of its own, where the operator reads a url once."""
    rules = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in urls.RULES)
    terms = ", ".join(f"('{t.strip('*')}', {t.startswith('*')}, {t.endswith('*')}, {t in urls.STRICT}, {0 if t in urls.STRICT else urls.SOFT[t]})" for t in {**urls.SOFT, **dict.fromkeys(urls.STRICT)})
    low = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""WITH r(v, h, p) AS (VALUES {rules}), t(core, l, r, strict, weight) AS (VALUES {terms}),
x AS (SELECT core, strict, weight, CASE WHEN l THEN '' ELSE '(?:^|[^\p{{L}}])' END || core || CASE WHEN r THEN '' ELSE '(?:$|[^\p{{L}}])' END pattern FROM t),
d AS (SELECT row_number() OVER () i, page_id, {low} u, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') h0, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path FROM pages),
e AS (SELECT i, page_id, u, path, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host FROM d),
w AS (SELECT i, arg_max(h || p, (length(h || p), length(h))) rule, arg_max(v, (length(h || p), length(h))) v FROM e JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY i),
k AS (SELECT i, count(*) FILTER (strict) n_strict, count(*) FILTER (NOT strict) n_soft, sum(weight)::BIGINT soft_weight FROM e JOIN x ON contains(u, core) AND regexp_matches(u, pattern) GROUP BY i)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN n_strict > 0 OR n_soft >= {urls.LEAST_SOFT} AND soft_weight >= {urls.SOFT_WEIGHT} THEN 'block' ELSE 'allow' END) verdict,
coalesce(n_strict, 0) n_strict, coalesce(n_soft, 0) n_soft, coalesce(soft_weight, 0) soft_weight FROM e LEFT JOIN w USING (i) LEFT JOIN k USING (i)"""
