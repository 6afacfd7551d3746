"""DuckDB SQL for the operators that SQL can express."""

from .mixing import MAX_REPEAT, WEIGHTS
from .quality import MAX_REPEAT_PERCENT, MIN_WORDS, RULES as QUALITY_RULES, STOP_WORDS, SYMBOLS
from .url_filter import BLOCK_WORDS, MAX_CHILDREN, PRIOR, PRIOR_N, REJECT_AT, RULES as URL_RULES, Z

WORD = r"[^\x20\x09-\x0D]+"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


EXACT_DEDUP = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

MIXING = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, CAST(list_extract({list(WEIGHTS)}, CAST((rank - 1) % {len(WEIGHTS)} + 1 AS BIGINT)) AS BIGINT) AS w, source_size * {MAX_REPEAT} AS cap FROM r),
o AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS left_,
             CAST(sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS w_left FROM w),
c AS (SELECT *, cap * w_left < w * left_ AS capped FROM o),
f AS (SELECT left_ AS fl, w_left AS fw FROM c WHERE NOT capped ORDER BY cap / w, rank LIMIT 1),
t AS (SELECT c.source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(w * fl AS DOUBLE) / CAST(fw AS DOUBLE) END AS target FROM c LEFT JOIN f ON true),
k AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
p AS (SELECT source, source_size, target, copies, target - copies * source_size AS rest FROM k),
g AS (SELECT d.source, d.h, sum(size) AS sz FROM d GROUP BY d.source, d.h),
u AS (SELECT *, sum(sz) OVER (PARTITION BY source ORDER BY h) - sz AS before FROM g),
e AS (SELECT p.source, u.h + CASE WHEN (p.rest - u.before) * 2 > u.sz THEN 1 ELSE 0 END AS below
      FROM p JOIN u ON p.source IS NOT DISTINCT FROM u.source WHERE p.rest > 0 AND p.rest - u.before >= 0 AND p.rest - u.before < u.sz)
SELECT d.doc_id, d.size, p.source_size, p.target, CAST(d.size * (p.copies + CASE WHEN d.h < coalesce(e.below, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""


def _quality_verdict() -> str:
    parts = []
    for top, bottom, low, high in QUALITY_RULES:
        if low is not None:
            parts.append(f"{top} * 100 >= {bottom} * {low}")
        if high is not None:
            parts.append(f"{top} * 100 <= {bottom} * {high}")
    return " AND ".join(parts)


QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '{WORD}') AS w FROM d),
x AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
y AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM x),
z AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM y WHERE n >= 2) GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         CAST(len(list_filter(w, lambda x: lower(x) IN ({', '.join(map(_quote, dict.fromkeys(STOP_WORDS)))}))) AS BIGINT) AS n_stop_words, CAST(len(l) AS BIGINT) AS n_lines
  FROM d JOIN w USING (rid) JOIN l USING (rid) LEFT JOIN z USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {_quality_verdict()} AS kept FROM b
"""


def _rule(what: int) -> str:
    whens = " ".join(
        f"WHEN (host = {_quote(h)} OR ends_with(host, {_quote('.' + h)})) AND starts_with(path, {_quote(p)}) THEN {_quote(h + p if what == 0 else v)}"
        for h, p, v in sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))
    )
    return f"CASE {whens} END"


def _seg(i: int) -> str:
    s = f"coalesce(list_filter(string_split(path, '/'), lambda x: x <> '')[{i}], '')"
    return rf"CASE WHEN regexp_matches({s}, '^[0-9]+(\.[A-Za-z0-9]+)?$') THEN regexp_replace({s}, '^[0-9]+', '{{n}}') WHEN regexp_matches({s}, '^[0-9a-fA-F-]{{8,}}$') THEN '{{x}}' ELSE {s} END"


def _similar(of: str, parent: str) -> str:
    rate = f"(CAST({parent}_b AS DOUBLE) / CAST({parent}_n AS DOUBLE))"
    return f"coalesce({of}_n > 0 AND CASE WHEN {of}_n > 0 AND {parent}_n > 0 THEN abs(CAST({of}_b AS DOUBLE) / {of}_n - {rate}) <= {Z} * sqrt({rate} * (1.0 - {rate}) / {of}_n) END, false)"


URLS = rf"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
v AS (SELECT *, {_rule(0)} AS rule, {_rule(1)} AS label, {_seg(1)} AS s1, {_seg(2)} AS s2 FROM h),
q AS (SELECT *, coalesce(label, CASE WHEN regexp_matches(host, '{"|".join(rf"(^|[.-]){w}([.-]|$)" for w in BLOCK_WORDS)}') THEN 'block' END) AS lab FROM v),
leaf AS (SELECT host, s1, s2, count(lab) AS n, count(CASE WHEN lab = 'block' THEN 1 END) AS b FROM q GROUP BY ALL),
hosts AS (SELECT host, sum(n) AS h_n, sum(b) AS h_b, count(DISTINCT s1) AS width FROM leaf GROUP BY host),
one AS (SELECT leaf.*, h_n, h_b, CASE WHEN width > {MAX_CHILDREN} THEN '*' ELSE s1 END AS t1 FROM leaf JOIN hosts USING (host)),
firsts AS (SELECT host, t1, sum(n) AS f_n, sum(b) AS f_b, count(DISTINCT s2) AS width2 FROM one GROUP BY ALL),
two AS (SELECT one.*, CASE WHEN {_similar("f", "h")} THEN '*' ELSE t1 END AS m1, CASE WHEN width2 > {MAX_CHILDREN} THEN '*' ELSE s2 END AS t2 FROM one JOIN firsts USING (host, t1)),
seconds AS (SELECT host, m1, t2, sum(n) AS s_n, sum(b) AS s_b FROM two GROUP BY ALL),
above AS (SELECT host, m1, sum(n) AS m_n, sum(b) AS m_b FROM two GROUP BY ALL),
joined AS (SELECT two.*, CASE WHEN {_similar("s", "m")} THEN '*' ELSE t2 END AS m2 FROM two JOIN seconds USING (host, m1, t2) JOIN above USING (host, m1)),
bad AS (SELECT host, m1, m2 FROM joined GROUP BY ALL HAVING (sum(b) + {PRIOR * PRIOR_N}) / (sum(n) + {PRIOR_N}) >= {REJECT_AT}),
no AS (SELECT DISTINCT host, s1, s2, true AS bad FROM joined JOIN bad USING (host, m1, m2))
SELECT page_id, v.host, path, rule, coalesce(label, CASE WHEN no.bad THEN 'block' ELSE 'allow' END) AS verdict
FROM v LEFT JOIN no ON v.host = no.host AND v.s1 = no.s1 AND v.s2 = no.s2
"""
