"""DuckDB SQL for the queries that SQL can express, written from their contracts."""

from __future__ import annotations

from . import mixing, quality

WS = r"[\x20\x09-\x0D]+"
_WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{WS}'), lambda t: t <> '')"

OP7 = rf"""
WITH norm AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{WS}', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER same AS kept, text_sha256
FROM norm WINDOW same AS (PARTITION BY text_sha256)
"""

OP4 = f"""
WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM t)),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM win) WHERE least < doc_id),
each AS (SELECT doc_id, w[p + 1] AS word, p FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS p FROM t)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS s, count(*) AS n FROM each ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (doc_id)
"""

OP6 = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM t)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
runs AS (SELECT doc_id, i, i - max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS step FROM late),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT *, count(*) FILTER (step IS NULL OR step > 100) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM runs) GROUP BY doc_id, g),
gaps AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a, b) AS b FROM (SELECT * FROM spans UNION ALL SELECT doc_id, 0, 0 FROM t)),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, len(h) // 2) - a)), '' ORDER BY a) AS h FROM gaps JOIN t USING (doc_id) GROUP BY doc_id),
gone AS (SELECT doc_id, sum(b - a)::bigint AS n, count(*) AS k FROM spans GROUP BY doc_id)
SELECT doc_id, len(t.h) // 2 AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(k, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM t JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
"""

OP10 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, strlen(t)::bigint AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * (k // 4) + 1, 5))::bigint >> (15 - 5 * (k % 4))) & 31)::bigint + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p
"""


def _op3() -> str:
    signals = {
        "symbols": "CASE WHEN n_words > 0 THEN 100.0::double * n_symbols / n_words ELSE 0 END",
        "dup_lines": "CASE WHEN n_lines > 0 THEN 100.0::double * n_dup_lines / n_lines ELSE 0 END",
        "repeats": "CASE WHEN n_words > 0 THEN 100.0::double * n_repeat_words / n_words ELSE 0 END",
        "capitals": "CASE WHEN word_chars > 0 THEN 100.0::double * n_capitals / word_chars ELSE 0 END",
        "shouts": "CASE WHEN n_words > 0 THEN 100.0::double * n_shouts / n_words ELSE 0 END",
    }
    risk = quality.RISK
    rung = "least(" + ", ".join("1 + " + " + ".join(f"({x} <= {float(c)}::double)::int" for c in quality.LADDER[k]) for k, x in signals.items()) + ")"
    return rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS s FROM (SELECT doc_id, w, unnest(range(0, len(w) - 2)) AS i FROM t)),
again AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1) GROUP BY doc_id),
m AS (SELECT doc_id, lang, len(w) AS n_words, length(regexp_replace(text, '{WS}', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    (len(l) - len(list_distinct(l)))::bigint AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words, len(l) AS n_lines,
    length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS n_capitals, length(regexp_replace(text, '[^!]+', '', 'g')) AS n_shouts FROM t LEFT JOIN again USING (doc_id)),
s AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {rung} AS rung FROM m),
held AS (SELECT s.* FROM s SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) USING (doc_id) WHERE NOT base_failed),
tests AS (SELECT lang, k, count(*) AS n, count(*) FILTER (rung <= k) AS x FROM held, range(1, {quality.RUNGS + 1}) r(k) GROUP BY lang, k),
judged AS (SELECT *, CASE WHEN x >= n * {risk} THEN 1 ELSE list_sum(list_transform(range(0, x + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({risk}) + (n - j) * ln({1 - risk})))) END
    <= n * {quality.DELTA} / (SELECT count(*) FROM held) AS passed FROM tests),
fit AS (SELECT lang, coalesce(min(k) FILTER (NOT passed), {quality.RUNGS + 1}) - 1 AS certified FROM judged GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rung > coalesce(certified, 0) AS kept FROM s LEFT JOIN fit ON s.lang IS NOT DISTINCT FROM fit.lang
"""


def _op8() -> str:
    rows, seed = mixing.SHARD_ROWS, mixing.SEED
    words = "CASE " + " ".join(f"WHEN target >= {mixing.LEAST_BLOCKS * b} THEN {b}" for b in (mixing.BLOCK >> k for k in range(mixing.BLOCK.bit_length()))) + " ELSE 1 END"
    w = ", ".join(f"{x}::double" for x in mixing.WEIGHTS)
    return f"""
WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size, md5('{seed}:' || coalesce(doc_id::varchar, '')) AS h FROM documents),
src AS (SELECT source, sum(size)::bigint AS source_size, count(*) AS n FROM d GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM src),
weighed AS (SELECT *, ([{w}])[r % {len(mixing.WEIGHTS)} + 1] AS w, 2.0::double * source_size AS cap FROM ranked),
levels AS (SELECT *, (1.5::double * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level FROM weighed WINDOW o AS (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fixed AS (SELECT arg_min(level, (cap / w, r)) AS level FROM levels WHERE level * w <= cap),
aims AS (SELECT source, source_size, n, CASE WHEN fixed.level IS NULL THEN cap ELSE least(cap, fixed.level * w) END AS target FROM levels, fixed),
tgt AS (SELECT *, {words} AS words FROM aims),
house AS (SELECT words, round(sum(target) / words)::bigint AS house FROM tgt GROUP BY words),
seats AS (SELECT source, count(*) AS seats FROM (SELECT source, words, row_number() OVER (PARTITION BY words ORDER BY q DESC, source NULLS LAST) AS place FROM (SELECT source, words, target / (2 * unnest(range(0, (target / words)::bigint + 40)) + 1) AS q FROM tgt)) JOIN house USING (words) WHERE place <= house GROUP BY source),
shard AS (SELECT d.*, ('0x' || substr(h, 1, 8))::bigint % greatest(1, ceil(n::double / {rows}))::bigint AS shard FROM d JOIN tgt ON d.source IS NOT DISTINCT FROM tgt.source),
line AS (SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY h, size ROWS UNBOUNDED PRECEDING)::bigint AS stop FROM shard),
sh AS (SELECT l.source, shard, sum(size)::bigint AS shard_size, greatest(floor(sum(size) / any_value(words)::double + 0.5), 1)::bigint AS blocks FROM line l JOIN tgt ON l.source IS NOT DISTINCT FROM tgt.source GROUP BY l.source, shard),
votes AS (SELECT sh.*, CASE WHEN source_size > 0 THEN target * shard_size / source_size ELSE 0 END AS votes, words, coalesce(seats, 0) AS source_seats FROM sh JOIN tgt ON sh.source IS NOT DISTINCT FROM tgt.source LEFT JOIN seats ON seats.source IS NOT DISTINCT FROM sh.source),
won AS (SELECT source, shard, count(*) AS seats FROM (SELECT source, shard, source_seats, row_number() OVER (PARTITION BY source ORDER BY q DESC, shard) AS place FROM (SELECT source, shard, source_seats, votes / (2 * unnest(range(0, (ceil(votes / greatest(shard_size, 1)) * blocks)::bigint)) + 1) AS q FROM votes)) WHERE place <= source_seats GROUP BY source, shard),
quota AS (SELECT v.*, coalesce(won.seats, 0) AS seats FROM votes v LEFT JOIN won ON won.source IS NOT DISTINCT FROM v.source AND won.shard = v.shard),
block AS (SELECT source, shard, b, b * shard_size // blocks AS a, (b + 1) * shard_size // blocks AS z, seats // blocks + (row_number() OVER (PARTITION BY source, shard ORDER BY md5('{seed}:' || coalesce(source, '') || ':' || shard || ':' || b), b) <= seats % blocks)::bigint AS times
    FROM (SELECT *, unnest(range(0, blocks)) AS b FROM quota)),
took AS (SELECT l.doc_id, l.size, l.source, l.stop, sum(greatest(least(l.stop, z) - greatest(l.stop - l.size, a), 0) * times)::bigint AS taken FROM line l JOIN block k ON k.source IS NOT DISTINCT FROM l.source AND k.shard = l.shard GROUP BY ALL)
SELECT doc_id, size, source_size, target, taken FROM took JOIN tgt ON took.source IS NOT DISTINCT FROM tgt.source
"""


OP3, OP8 = _op3(), _op8()

OP11 = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
v AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
      map {{'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
            'D': regexp_matches(text, '[#$%&*|]'), 'E': doc_id > min(doc_id) OVER (PARTITION BY text)}} AS f FROM d LEFT JOIN l USING (doc_id)),
g AS (SELECT part, good, toxic, f, count(*) AS n FROM v GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT array_to_string(o, '') AS filter_order, step, o[step] AS filter, o[1:step - 1] AS before FROM (SELECT o, unnest(range(1, 6)) AS step FROM o)),
c AS (SELECT part, filter_order, step::int AS step, filter,
      sum(CASE WHEN len(list_filter(before, lambda b: f[b])) = 0 AND NOT f[filter] THEN n ELSE 0 END)::bigint AS kept,
      sum(CASE WHEN len(list_filter(before, lambda b: f[b])) = 0 AND f[filter] THEN n ELSE 0 END)::bigint AS removed,
      sum(CASE WHEN len(list_filter(before, lambda b: f[b])) > 0 AND f[filter] THEN n ELSE 0 END)::bigint AS redundant,
      sum(CASE WHEN f[filter] AND len(list_filter(map_values(f), lambda b: b)) = 1 THEN n ELSE 0 END)::bigint AS unique_fails,
      sum(CASE WHEN len(list_filter(before, lambda b: f[b])) = 0 AND f[filter] AND good THEN n ELSE 0 END)::bigint AS good_lost,
      sum(CASE WHEN len(list_filter(before, lambda b: f[b])) = 0 AND f[filter] AND toxic THEN n ELSE 0 END)::bigint AS toxic_lost
      FROM s, g GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, filter)::bigint AS shapley FROM c
"""

OP13 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id) AS h FROM documents),
k AS (SELECT *, len(u) AS n, list_transform(range(0, 4), lambda i: ('0x' || substr(h, 8 * i + 1, 8))::bigint) AS k FROM t),
c AS (SELECT *, least(k[1] % (n + 1), k[2] % (n + 1)) AS a, greatest(k[1] % (n + 1), k[2] % (n + 1)) AS b,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR k[3] % 100 >= 50 THEN 'plain' WHEN k[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
