"""DuckDB SQL for the opN_ queries that SQL can express."""

from __future__ import annotations

#: Rounds of PageRank, over which what is left of a start is below 1e-7.
ROUNDS = 104
NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')"

OP10 = f"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS size, {NORMAL} AS normal FROM documents)
SELECT doc_id, first(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY normal) AS group_size, row_number() OVER w = 1 AS kept, sha256(normal) AS text_sha256
FROM n WINDOW w AS (PARTITION BY normal ORDER BY size DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""

OP7 = f"""
WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM s q JOIN s c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP6 = """
SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN NULL ELSE first_id END AS refers_to
FROM (SELECT page_id, html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(5), lambda b:
    ((strpos('0123456789abcdef', substr(sha1(coalesce(html, '')), 1 + CAST((i * 5 + b) // 4 AS INTEGER), 1)) - 1) >> CAST(3 - (i * 5 + b) % 4 AS INTEGER)) % 2 << CAST(4 - b AS INTEGER))) AS INTEGER), 1)), '') AS payload_digest
  FROM pages)
"""


def op8() -> str:
    """The mix: the levels of the filling and the seeds' sums as common table expressions."""
    rounds = 24
    steps, last = [], "l0"
    for i in range(1, rounds + 1):
        steps.append(f"""l{i} AS (SELECT greatest({last}.lv, (SELECT CASE WHEN coalesce(sum(CASE WHEN most > weight * {last}.lv THEN weight END), 0) > 0
  THEN ((SELECT tot FROM total) - coalesce(sum(CASE WHEN most <= weight * {last}.lv THEN most END), 0)) / sum(CASE WHEN most > weight * {last}.lv THEN weight END) ELSE {last}.lv END FROM w)) AS lv FROM {last})""")
        last = f"l{i}"
    u = lambda seed: f"(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || {seed}), 1, 8) AS BIGINT) / 4294967296.0)"
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT source, source_size, source_size * 2.0 AS most, CAST(list_extract([3.0, 1.0, 2.0], CAST(place % 3 AS INTEGER) + 1) AS DOUBLE) AS weight FROM s),
total AS (SELECT CAST(sum(source_size) AS DOUBLE) * 1.5 AS tot FROM w),
l0 AS (SELECT (SELECT tot FROM total) / (SELECT sum(weight) FROM w) AS lv),
{", ".join(steps)},
t AS (SELECT source, source_size, least(most, weight * lv) AS target, CASE WHEN source_size > 0 THEN least(most, weight * lv) / source_size ELSE 0.0 END AS rate FROM w, {last}),
c AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.rate FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT source, seed, abs(sum(size * (floor(rate) + CASE WHEN {u("seed")} < rate - floor(rate) THEN 1 ELSE 0 END)) - first(target)) AS off FROM c, (SELECT CAST(range AS VARCHAR) AS seed FROM range(16)) GROUP BY source, seed),
b AS (SELECT source, first(seed ORDER BY off, CAST(seed AS INTEGER)) AS seed FROM k GROUP BY source)
SELECT c.doc_id, c.size, c.source_size, c.target, CAST(c.size * (floor(c.rate) + CASE WHEN {u("b.seed")} < c.rate - floor(c.rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source
"""


OP5 = r"""
WITH l AS (SELECT r, text, unnest(range(len(ls))) AS place, unnest(ls) AS line FROM (SELECT row_number() OVER () AS r, text, string_split(text, chr(10)) AS ls FROM documents)),
t AS (SELECT r, text, place, line, list_transform(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda t: t <> ''), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS t FROM l),
f AS (SELECT *, len(t) AS n, 4 + (len(t) - 4) // 2 AS half FROM t),
k AS (SELECT r, text, place, 'whole ' || array_to_string(t, ' ') AS template, CASE WHEN n > 50 THEN 2 ELSE 10 END AS least FROM f WHERE n > 0
  UNION ALL SELECT r, text, place, 'first ' || n || ' ' || array_to_string(t[1:half], ' '), 10 FROM f WHERE n >= 8
  UNION ALL SELECT r, text, place, 'second ' || n || ' ' || array_to_string(t[1:4], ' ') || ' .. ' || array_to_string(t[half + 1:n], ' '), 10 FROM f WHERE n >= 8),
g AS (SELECT template FROM k GROUP BY template HAVING count(DISTINCT text) >= max(least)),
fw AS (SELECT DISTINCT text, t, n, n || ' ' || array_to_string(t[1:3], ' ') AS leaf FROM f WHERE n >= 8),
fs AS (SELECT leaf, count(*) AS lines, count(DISTINCT text) AS texts FROM fw GROUP BY leaf HAVING count(DISTINCT text) >= 10),
ft AS (SELECT leaf, lines, unnest(range(n)) AS p, unnest(t) AS w FROM fw JOIN fs USING (leaf)),
fc AS (SELECT leaf, p, w FROM ft WHERE w <> '<*>' GROUP BY leaf, p, w, lines HAVING count(*) >= 10 AND count(*) * 16 >= lines),
fm AS (SELECT leaf, list(p || ' ' || w) AS c FROM fc GROUP BY leaf),
fx AS (SELECT leaf, text, t, n, texts, list_transform(t, lambda w, i: CASE WHEN list_contains(c, (i - 1) || ' ' || w) THEN w ELSE '<*>' END) AS x FROM fw JOIN fs USING (leaf) JOIN fm USING (leaf)),
fy AS (SELECT leaf, text, t, texts, array_to_string(x, ' ') AS x FROM fx WHERE 2 * len(list_filter(x[4:n], lambda w: w <> '<*>')) > n - 3),
fg AS (SELECT leaf, x FROM fy GROUP BY leaf, x, texts HAVING count(DISTINCT text) >= 10 AND count(DISTINCT text) * 64 >= texts),
fd AS (SELECT DISTINCT text, t FROM fy JOIN fg USING (leaf, x)),
gone AS (SELECT r, place FROM k JOIN g USING (template) UNION SELECT r, place FROM f JOIN fd ON f.text = fd.text AND f.t = fd.t),
s AS (SELECT l.r, count(*) AS n_lines, count(gone.r) AS n_dropped, coalesce(string_agg(CASE WHEN gone.r IS NULL THEN l.line END, chr(10) ORDER BY l.place), '') AS kept FROM l LEFT JOIN gone ON l.r = gone.r AND l.place = gone.place GROUP BY l.r)
SELECT d.doc_id, coalesce(s.n_lines, 0) AS n_lines, coalesce(s.n_dropped, 0) AS n_dropped, CASE WHEN d.text IS NOT NULL THEN sha256(s.kept) END AS text_sha256
FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents) d LEFT JOIN s USING (r)
"""


def op9() -> str:
    """PageRank as recursive queries: ROUNDS steps of trust along the links and of distrust against them."""
    after = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END"
    ordered = (("allow", "www.example.com", "/en/"), ("block", "example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"), ("allow", "com", "/"))
    case = lambda f: "CASE " + " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{f(v, h, p)}'" for v, h, p in ordered) + " END"
    lower = f"translate({{}}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    link = r"""(?i)(?:href|src)\s*=\s*["'']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)"""
    steps = []
    for kind, edges, seed in (("t", "e", "allowed"), ("x", "v", "blocked")):
        steps.append(f"""{kind}s AS (SELECT host, {seed} / (allowed + blocked) AS seed FROM sums WHERE {seed} > 0),
{kind} AS (SELECT 0 AS i, host, seed AS score FROM {kind}s UNION ALL SELECT i + 1, host, sum(score) FROM (SELECT n.i, l.dst AS host, l.weight * n.score * 0.85 AS score FROM {edges} l JOIN {kind} n ON l.src = n.host WHERE n.i < {ROUNDS}
  UNION ALL SELECT n.i, s.host, s.seed * 0.15 FROM {kind}s s, (SELECT DISTINCT i FROM {kind} WHERE i < {ROUNDS}) n) GROUP BY i, host)""")
    return f"""
WITH RECURSIVE u AS (SELECT page_id, html, {after} AS rest FROM pages),
h AS (SELECT page_id, html, coalesce({lower.format("regexp_extract(rest, '^([^/?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
j AS (SELECT *, {case(lambda v, h, p: v)} AS own, {case(lambda v, h, p: h + p)} AS rule FROM h),
sums AS (SELECT host, CAST(count(*) FILTER (WHERE own = 'allow') AS DOUBLE) AS allowed, CAST(count(*) FILTER (WHERE own = 'block') AS DOUBLE) AS blocked FROM j WHERE host <> '' GROUP BY host),
links AS (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, {lower.format(f"unnest(regexp_extract_all(html, '{link}', 1))")} AS dst FROM j WHERE host <> '' AND html IS NOT NULL) WHERE src <> dst GROUP BY src, dst),
e AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS weight FROM links),
v AS (SELECT dst AS src, src AS dst, weight / sum(weight) OVER (PARTITION BY dst) AS weight FROM e),
{", ".join(steps)},
bad AS (SELECT host FROM (SELECT host, score AS trust, 0.0 AS distrust FROM t WHERE i = {ROUNDS} UNION ALL SELECT host, 0.0, score FROM x WHERE i = {ROUNDS}) GROUP BY host HAVING sum(distrust) >= 1e-12 AND sum(distrust) > 1.0001 * sum(trust))
SELECT page_id, j.host, path, rule, coalesce(own, CASE WHEN bad.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN bad ON j.host = bad.host
"""


def op11() -> str:
    """Both kinds of trees level by level; each leaf's siblings are the nodes at its ancestors' places with the last bit turned."""
    text = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda n: "sha256(" + " || ".join(text(c) for c in ("doc_id", "source", "lang", n, "text")) + ")"
    crc = "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: list_reduce(range(8), lambda k, i: xor(k >> 1, 3988292384 * (k & 1)), xor(c, b)), 4294967295), 4294967295)"
    up = lambda name, start, tree: f"""{name} AS ({start} UNION ALL SELECT l + 1, {tree}, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY l, {tree}, i // 2, n)"""
    step = "sha256(CASE WHEN f.i % 2 = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END)"
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, lang, {leaf("n_chars")} AS leaf,
  CASE WHEN n_chars IS NOT NULL AND {crc} % 7 = 0 THEN {leaf("(CAST(n_chars AS HUGEINT) + 1)")} END AS claimed FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS size FROM d),
{up("lv", "SELECT 0 AS l, lang, place AS i, size AS n, leaf AS h FROM p", "lang")},
sub AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS size FROM lv WHERE n = 1),
{up("tp", "SELECT 0 AS l, 0 AS tree, place AS i, size AS n, subroot AS h FROM sub", "tree")},
sib AS (SELECT p.r, 0 AS kind, s.l, s.h FROM p JOIN lv s ON s.lang IS NOT DISTINCT FROM p.lang AND s.i = xor(p.place >> s.l, 1)
  UNION ALL SELECT p.r, 1, s.l, s.h FROM p JOIN sub u ON u.lang IS NOT DISTINCT FROM p.lang JOIN tp s ON s.i = xor(u.place >> s.l, 1)),
proof AS (SELECT r, sha256(string_agg(h, '' ORDER BY kind, l)) AS proof_sha256 FROM sib GROUP BY r),
f0 AS (SELECT r, 0 AS l, lang, place AS i, size AS n, coalesce(claimed, leaf) AS h FROM p
  UNION ALL SELECT f.r, f.l + 1, f.lang, f.i // 2, (f.n + 1) // 2, {step} FROM f0 f LEFT JOIN lv s ON s.l = f.l AND s.lang IS NOT DISTINCT FROM f.lang AND s.i = xor(f.i, 1) WHERE f.n > 1),
f1 AS (SELECT f.r, 0 AS l, u.place AS i, u.size AS n, f.h FROM f0 f JOIN sub u ON u.lang IS NOT DISTINCT FROM f.lang WHERE f.n = 1
  UNION ALL SELECT f.r, f.l + 1, f.i // 2, (f.n + 1) // 2, {step} FROM f1 f LEFT JOIN tp s ON s.l = f.l AND s.i = xor(f.i, 1) WHERE f.n > 1)
SELECT p.doc_id, p.leaf, sub.subroot, root.h AS root, coalesce(proof.proof_sha256, sha256('')) AS proof_sha256, f1.h AS folded_root, f1.h = root.h AS verified
FROM p JOIN sub ON sub.lang IS NOT DISTINCT FROM p.lang JOIN f1 ON f1.r = p.r AND f1.n = 1 LEFT JOIN proof ON proof.r = p.r, (SELECT h FROM tp WHERE n = 1) root
"""


OP13 = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
c AS (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, unnest(ts) AS term FROM t) GROUP BY r, doc_id, term),
n AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM c GROUP BY r),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
m AS (SELECT r, 25 + (75 * n * docs) // terms AS m FROM n, s),
i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM benchmark),
k AS (SELECT q, item_id, term, count(*) AS k FROM (SELECT q, item_id, unnest(ts) AS term FROM i) GROUP BY q, item_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM c, s GROUP BY term, docs),
p AS (SELECT q, item_id, r, doc_id, CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM k JOIN c USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY q, item_id, r, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM p WHERE score > 0) WHERE rank <= 10
"""


ORACLES: dict[str, str] = {"op5_line_dedup": OP5, "op6_warc": OP6, "op7_top_k": OP7, "op8_mixing": op8(), "op9_url_filters": op9(), "op10_exact_dedup": OP10, "op11_merkle": op11(), "op13_ranked_search": OP13}
