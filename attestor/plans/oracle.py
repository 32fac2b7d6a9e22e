"""DuckDB expressions and common table expressions that the oracle queries share.

They are written against DuckDB's own functions (no look-behind, ASCII classes), not translated
from the Column expressions, so that the two check each other. Thresholds are written out here; fixed word lists and
patterns are those of the functions, whose golden cases tests/test_parsing.py holds.
"""

from __future__ import annotations

from attestor.functions import parsing
from attestor.operators import adjudication as adj
from attestor.operators import resolution as res
from attestor.operators import layout as lay
from attestor.operators import passages as pas
from attestor.sources import adapters
from attestor.sources.adapters import FACTS

WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
PUNCTUATION = rf"[^\p{{L}}\p{{N}}\p{{M}}_{WS[1:]}"


def listed(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def collapse(x: str) -> str:
    return f"array_to_string({words(x)}, ' ')"


def plain(x: str) -> str:
    return collapse(f"regexp_replace(lower(coalesce({x}, '')), '{PUNCTUATION}', ' ', 'g')")


def shorten(x: str, n: int) -> str:
    tidy = f"coalesce({collapse(x)}, '')"
    return f"CASE WHEN length({tidy}) <= {n} THEN {tidy} ELSE substr({tidy}, 1, {n - 3}) || '...' END"


def readable_id(prefix: str, x: str) -> str:
    slug = f"regexp_replace(substr(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), 1, 44), '^_+|_+$', '', 'g')"
    return f"'{prefix}_' || {slug} || '_' || substr(sha1({x}), 1, 8)"


def scale(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({x}), '(^|[^a-z])({w})([^a-z]|$)') THEN {m:.1f}" for m, w in parsing.SCALES) + " ELSE 1.0 END"


def currency(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({x}), '{w}') THEN '{c}'" for c, w in parsing.CURRENCIES) + " END"


def percentage(v: str, u: str) -> str:
    return f"(contains({v}, '%') OR lower({trim(f'coalesce({u}, $$$$)')}) IN ({listed(parsing.PERCENT_UNITS)}))"


def digits(v: str) -> str:
    return f"regexp_extract({trim(v)}, '-?[0-9][0-9,]*\\.?[0-9]*')"


def multiplier(v: str, u: str) -> str:
    return f"CAST(CASE WHEN {digits(v)} = '' OR {trim(v)} = '' OR {v} IS NULL THEN 1.0 WHEN {percentage(v, u)} THEN 1.0 WHEN {scale(v)} <> 1.0 THEN {scale(v)} ELSE {scale(f'coalesce({u}, $$$$)')} END AS DOUBLE)"


def number(v: str, u: str) -> str:
    sign = f"CASE WHEN regexp_matches({trim(v)}, '^[(-]') THEN -1.0 ELSE 1.0 END"
    return f"(abs(TRY_CAST(replace({digits(v)}, ',', '') AS DOUBLE)) * {multiplier(v, u)} * CAST({sign} AS DOUBLE))"


def month_number(m: str) -> str:
    return f"((strpos('janfebmaraprmayjunjulaugsepoctnovdec', lower(substr({m}, 1, 3))) + 2) // 3)"


def made_date(y: str, m: str, d: str) -> str:
    made = f"TRY_CAST(lpad(CAST({y} AS VARCHAR), 4, '0') || '-' || lpad(CAST({m} AS VARCHAR), 2, '0') || '-' || lpad(CAST({d} AS VARCHAR), 2, '0') AS DATE)"
    return f"CASE WHEN {made} BETWEEN DATE '1900-01-01' AND DATE '2100-12-31' THEN {made} END"


def year(digits_: str) -> str:
    return f"CASE WHEN TRY_CAST({digits_} AS INTEGER) < 100 THEN TRY_CAST({digits_} AS INTEGER) + 2000 ELSE TRY_CAST({digits_} AS INTEGER) END"


def part(x: str, p: str, i: int) -> str:
    return f"regexp_extract({x}, '(?i)" + p.replace("'", "''") + f"', {i})"


def has(x: str, p: str) -> str:
    return f"regexp_matches({x}, '(?i)" + p.replace("'", "''") + "')"


def date(x: str) -> str:
    p, t = parsing, trim(x)
    cases = [
        (p.YEAR_MONTH_DAY, made_date(*(part(t, p.YEAR_MONTH_DAY, i) for i in (1, 2, 3)))),
        (p.MONTH_DAY_YEAR, made_date(part(t, p.MONTH_DAY_YEAR, 3), month_number(part(t, p.MONTH_DAY_YEAR, 1)), part(t, p.MONTH_DAY_YEAR, 2))),
        (p.DAY_MONTH_YEAR, made_date(part(t, p.DAY_MONTH_YEAR, 3), month_number(part(t, p.DAY_MONTH_YEAR, 2)), part(t, p.DAY_MONTH_YEAR, 1))),
        (p.DAY_MONTH_YEAR_DIGITS, made_date(*(part(t, p.DAY_MONTH_YEAR_DIGITS, i) for i in (3, 2, 1)))),
        (p.MONTH_YEAR, f"last_day({made_date(year(part(t, p.MONTH_YEAR, 2)), month_number(part(t, p.MONTH_YEAR, 1)), '1')})"),
        (p.YEAR, made_date(part(t, p.YEAR, 1), "12", "31")),
    ]
    return "CASE " + " ".join(f"WHEN {has(t, q)} THEN {v}" for q, v in cases) + " END"


def back(end: str, months: str) -> str:
    return f"CAST(date_trunc('month', {end} - to_months(CAST({months} AS INTEGER) - 1)) AS DATE)"


def period(x: str, end: str, m: str, d: str) -> tuple[str, str]:
    """Start and end of a period phrase. x: column, end: column with its parsed date, m and d: the year's end."""
    p = parsing
    fy = lambda q, i: f"make_date({year(part(x, q, i))}, {m}, {d})"
    quarter = f"CAST({back(fy(p.QUARTER_OF_YEAR, 2), '12')} + to_months((CAST({part(x, p.QUARTER_OF_YEAR, 1)} AS INTEGER) - 1) * 3) AS DATE)"
    word = f"lower({part(x, p.MONTHS_ENDED, 1)})"
    n = "CASE " + " ".join(f"WHEN {word} = '{w}' THEN {k}" for w, k in p.MONTH_COUNTS.items()) + f" ELSE TRY_CAST({word} AS INTEGER) END"
    cases = [
        (has(x, p.QUARTER_OF_YEAR), quarter, f"last_day(CAST({quarter} + to_months(2) AS DATE))"),
        (f"{end} IS NOT NULL AND {has(x, p.MONTHS_ENDED)}", back(end, n), end),
        (f"{end} IS NOT NULL AND {has(x, p.QUARTER_ENDED)}", back(end, "3"), end),
        (f"{end} IS NOT NULL AND {has(x, p.YEAR_ENDED)}", back(end, "12"), end),
        (has(x, p.FINANCIAL_YEAR), back(fy(p.FINANCIAL_YEAR, 1), "12"), fy(p.FINANCIAL_YEAR, 1)),
        (f"{end} IS NOT NULL", end, end),
    ]
    return tuple("CASE " + " ".join(f"WHEN {c[0]} THEN {c[i]}" for c in cases) + " END" for i in (1, 2))


def simple_name(x: str) -> str:
    kept = f"array_to_string(list_filter({words(plain(x))}, lambda w: w NOT IN ({listed(res.LEGAL_FORMS)})), ' ')"
    return f"CASE WHEN {kept} = '' THEN {plain(x)} ELSE {kept} END"


def tags(x: str) -> str:
    return f"list_sort(list_distinct(list_filter({words(plain(x))}, lambda w: length(w) > 2 AND w NOT IN ({listed(res.STOPWORDS)}))))"


def signature(x: str) -> str:
    return f"list_sort(list_distinct(list_filter({words(plain(x))}, lambda w: w IN ({listed(res.MEASURES)}))))"


def self_reference(x: str) -> str:
    return f"{plain(x)} IN ({listed(res.SELF_REFERENCES)})"


YEAR_END = f"""yp AS (SELECT fact_id, {date("period_raw")} AS d FROM facts WHERE {has("period_raw", parsing.YEAR_ENDED)}),
ye AS (SELECT month(d) AS m, day(d) AS d, count(*) AS n, min(fact_id) AS first FROM yp WHERE d IS NOT NULL GROUP BY ALL),
fy AS (SELECT coalesce((SELECT m FROM ye ORDER BY n DESC, first LIMIT 1), 12) AS m, coalesce((SELECT d FROM ye ORDER BY n DESC, first LIMIT 1), 31) AS d)"""

_start, _end = period("tp", "pd", "(SELECT m FROM fy)", "(SELECT d FROM fy)")
FACT_CTE = f"facts AS ({FACTS.strip()})"
#: Facts with parsed values: CTEs facts, fy and nf.
NORMALISED = f"""{FACT_CTE}, {YEAR_END},
r0 AS (SELECT *, {trim("period_raw")} AS tp, {date("period_raw")} AS pd FROM facts),
nf AS MATERIALIZED (SELECT fact_id, doc_id, page_no, entity_id, attribute_family, subject_raw, attribute_raw, value_kind, value_raw, unit, value_text, period_raw, as_of_raw, scope_raw, confidence, grounded, value_in_evidence,
  CASE WHEN value_kind = 'number' THEN {number("value_raw", "unit")} END AS value_num,
  CASE WHEN value_kind = 'number' THEN {multiplier("value_raw", "unit")} END AS multiplier,
  CASE WHEN value_kind = 'number' THEN coalesce(currency, {currency("value_raw")}, {currency("coalesce(unit, '')")}) ELSE currency END AS currency,
  {_start} AS period_start, {_end} AS period_end, {date("as_of_raw")} AS as_of_date, {tags("scope_raw")} AS scope_tags FROM r0)"""

PAIRS = f"""{NORMALISED},
cf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, attribute_family ORDER BY coalesce(confidence, 0) DESC, fact_id) AS place FROM nf WHERE grounded AND (value_num IS NOT NULL OR value_text IS NOT NULL)) WHERE place <= 120),
pr AS (SELECT 'rel_' || a.fact_id || '__' || b.fact_id AS relation_id, a, b FROM cf a JOIN cf b ON a.entity_id = b.entity_id AND a.attribute_family = b.attribute_family AND a.fact_id < b.fact_id
  WHERE NOT (a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.value_num IS NOT DISTINCT FROM b.value_num AND a.value_text IS NOT DISTINCT FROM b.value_text AND a.period_start IS NOT DISTINCT FROM b.period_start AND a.as_of_date IS NOT DISTINCT FROM b.as_of_date AND a.scope_raw IS NOT DISTINCT FROM b.scope_raw))"""


def difference(x: str, y: str) -> str:
    return f"CASE WHEN greatest(abs({x}), abs({y})) = 0 THEN 0.0 ELSE abs({x} - {y}) / greatest(abs({x}), abs({y})) END"


def proportion(s: str) -> str:
    return f"(contains(coalesce({s}.value_raw, ''), '%') OR lower({trim(f'coalesce({s}.unit, $$$$)')}) IN ('%', 'percent', 'percentage', 'pct', 'bps', 'basis points'))"


def bound(s: str) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce({s}.value_raw, '')), '{b}')" for b in (">", "<", "~", "≈", "+", "at least", "more than", "over")) + ")"


_ratio = "(greatest(abs(a.value_num), abs(b.value_num)) / least(abs(a.value_num), abs(b.value_num)))"
_moment = lambda s: f"coalesce({s}.period_end, {s}.as_of_date)"
_text = lambda s: f"lower({trim(f'coalesce({s}.value_text, $$$$)')})"
_trust = lambda s: f"(CASE WHEN coalesce({s}.confidence, 0) = 0 THEN 1 ELSE {s}.confidence END)"
_off = difference("a.value_num", "b.value_num")
POWER = f"CASE WHEN a.value_num <> 0 AND b.value_num <> 0 AND {_ratio} >= 9.9 THEN (SELECT min(k) FROM range(1, 40) t(k) WHERE {_ratio} / pow(10, k) < 9.9 AND abs({_ratio} / pow(10, k) - 1) <= 0.01) END"
LEAF = f"""CASE WHEN a.currency <> b.currency THEN 'R1'
  WHEN (a.value_num IS NULL) <> (b.value_num IS NULL) THEN 'R2'
  WHEN {proportion("a")} <> {proportion("b")} THEN 'R3'
  WHEN a.period_start IS NOT NULL AND b.period_start IS NOT NULL AND (a.period_start <> b.period_start OR a.period_end IS DISTINCT FROM b.period_end) THEN 'R4'
  WHEN {_moment("a")} <> {_moment("b")} AND a.value_num IS NULL AND {_text("a")} <> {_text("b")} THEN 'R5'
  WHEN {_moment("a")} <> {_moment("b")} AND a.value_num IS NOT NULL THEN 'R6'
  WHEN len(a.scope_tags) > 0 AND len(b.scope_tags) > 0 AND len(list_intersect(a.scope_tags, b.scope_tags)) / len(list_distinct(list_concat(a.scope_tags, b.scope_tags))) < 0.5 THEN 'R7'
  WHEN a.value_num IS NULL AND {_text("a")} = {_text("b")} THEN 'R8'
  WHEN a.value_num IS NULL THEN 'R9'
  WHEN {_off} <= 0.005 THEN 'R10'
  WHEN ({POWER}) IS NOT NULL THEN 'R11'
  WHEN {bound("a")} OR {bound("b")} THEN 'R12'
  WHEN {_trust("a")} < 0.6 AND {_trust("b")} < 0.6 THEN 'R14' ELSE 'R15' END"""

VERDICTS = f"""{PAIRS},
lf AS MATERIALIZED (SELECT relation_id, a, b, {LEAF} AS leaf0 FROM pr),
op AS (SELECT *, unnest(list_distinct([floor(ln(gap * 0.996) / 0.0041), floor(ln(gap) / 0.0041), floor(ln(gap * 1.004) / 0.0041)])) AS band FROM (SELECT *, abs(a.value_num - b.value_num) AS gap FROM lf WHERE leaf0 IN ('R14', 'R15'))
  WHERE gap >= 50 AND {difference("gap", "abs(a.value_num)")} > 0.05 AND {difference("gap", "abs(b.value_num)")} > 0.05),
cn AS MATERIALIZED (SELECT *, floor(ln(value_num) / 0.0041) AS band FROM nf WHERE grounded AND value_num >= 1),
br AS (SELECT p.relation_id, count(*) AS n, min(c.fact_id) AS bridging_fact_id
  FROM op p JOIN cn c ON p.a.entity_id = c.entity_id AND p.band = c.band
  WHERE c.fact_id NOT IN (p.a.fact_id, p.b.fact_id) AND {proportion("c")} = {proportion("p.a")}
    AND (coalesce(c.as_of_date = p.a.as_of_date, false) OR coalesce(c.as_of_date = p.b.as_of_date, false) OR coalesce(c.period_end = p.a.period_end, false) OR coalesce(c.period_end = p.b.period_end, false)
      OR (p.a.as_of_date IS NULL AND p.b.as_of_date IS NULL AND p.a.period_end IS NULL AND p.b.period_end IS NULL))
    AND {difference("c.value_num", "p.gap")} <= 0.002 GROUP BY p.relation_id HAVING count(*) = 1),
vd AS (SELECT l.relation_id, l.a.fact_id AS fact_a, l.b.fact_id AS fact_b, CASE WHEN br.n = 1 THEN 'R13' ELSE l.leaf0 END AS leaf, br.bridging_fact_id, l.a AS a, l.b AS b FROM lf l LEFT JOIN br USING (relation_id)),
rl AS (SELECT *, CASE WHEN leaf IN ('R1', 'R2', 'R3') THEN 'unrelated' WHEN leaf IN ('R4', 'R6', 'R7', 'R11', 'R12', 'R13') THEN 'reconciled' WHEN leaf = 'R5' THEN 'superseded' WHEN leaf IN ('R8', 'R10') THEN 'corroborates' WHEN leaf = 'R9' THEN 'needs_a_judgement' ELSE 'contradicts' END AS verdict,
  CASE WHEN leaf = 'R13' THEN 'derivation' ELSE 'rule' END AS method FROM vd)"""

_CAPPED = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, attribute_family ORDER BY coalesce(confidence, 0) DESC, fact_id) AS place FROM nf WHERE grounded AND (value_num IS NOT NULL OR value_text IS NOT NULL)) WHERE place <= 120"
#: VERDICTS on all pairs of every bucket.
WHOLE = VERDICTS.replace(_CAPPED, "SELECT * FROM nf WHERE grounded AND (value_num IS NOT NULL OR value_text IS NOT NULL)")

#: WHOLE on the candidates of all grounded facts, after those without their value in the evidence stopped being grounded.
LOST = WHOLE.replace(f", {LEAF} AS leaf0", f", CASE WHEN NOT a.value_in_evidence OR NOT b.value_in_evidence THEN 'R19' ELSE {LEAF} END AS leaf0").replace("WHERE grounded AND value_num >= 1", "WHERE grounded AND value_in_evidence AND value_num >= 1")
LOST = LOST.replace("CASE WHEN leaf IN ('R1', 'R2', 'R3')", "CASE WHEN leaf = 'R19' THEN 'candidate' WHEN leaf IN ('R1', 'R2', 'R3')").replace("CASE WHEN leaf = 'R13' THEN 'derivation'", "CASE WHEN leaf = 'R19' THEN 'blocking' WHEN leaf = 'R13' THEN 'derivation'")

PAGE_CTE = f"pages_ AS ({adapters.PAGES.replace('{map}', adapters.DUCKDB_NOTES).strip()})"
_T, _N = lay.TABLES_MARK, lay.FOOTNOTES_MARK
REGIONS = f"""{PAGE_CTE},
mk AS (SELECT *, nullif(strpos(raw_text, '{_T}'), 0) - 1 AS t, nullif(strpos(raw_text, '{_N}'), 0) - 1 AS f, length(raw_text) AS n FROM pages_ WHERE {trim("raw_text")} <> ''),
rg AS (SELECT doc_id, page_no, raw_text, 'prose' AS kind, 1 AS k, 0 AS s, least(coalesce(t, n), coalesce(f, n)) AS e FROM mk
  UNION ALL SELECT doc_id, page_no, raw_text, 'table', 2, t + {len(_T)}, CASE WHEN f > t THEN f ELSE n END FROM mk WHERE t IS NOT NULL
  UNION ALL SELECT doc_id, page_no, raw_text, 'footnotes', 3, f + {len(_N)}, n FROM mk WHERE f IS NOT NULL)"""
_lead = lambda x: f"(length({x}) - length(regexp_replace({x}, '^{WS}+', '')))"
_body = lambda x: f"length({trim(x)})"
_count = lambda x: f"len({words(x)})"
PARAGRAPHS = f"""{REGIONS},
p0 AS (SELECT doc_id, kind, k, s, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM (SELECT *, string_split(substr(raw_text, s + 1, e - s), chr(10) || chr(10)) AS ps FROM rg)),
p1 AS (SELECT *, s + coalesce(sum(length(p) + 2) OVER (PARTITION BY doc_id, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM p0),
pp AS (SELECT doc_id, kind, k, i, trim_p AS p, CAST(off + ld AS INTEGER) AS s, CAST(off + ld + length(trim_p) AS INTEGER) AS e, CAST({_count("trim_p")} AS INTEGER) AS w FROM (SELECT *, {_lead("p")} AS ld, {trim("p")} AS trim_p FROM p1) WHERE trim_p <> '')"""
SENTENCES = f"""{PARAGRAPHS},
s0 AS (SELECT doc_id, kind, k, i, s, unnest(ss) AS p, unnest(range(len(ss))) AS j FROM (SELECT *, regexp_extract_all(p, '(?s).+?(?:[.!?]{WS}+|$)') AS ss FROM pp WHERE w > 1500)),
s1 AS (SELECT *, s + coalesce(sum(length(p)) OVER (PARTITION BY doc_id, kind, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM s0),
sp AS (SELECT doc_id, kind, k, i, 0 AS j, s, e, w FROM pp WHERE w <= 1500
  UNION ALL SELECT doc_id, kind, k, i, j, CAST(off + {_lead("p")} AS INTEGER), CAST(off + {_lead("p")} + {_body("p")} AS INTEGER), CAST({_count("p")} AS INTEGER) FROM s1 WHERE {trim("p")} <> '')"""
_refs = f"list_transform(flatten(list_transform(regexp_extract_all(text, '{lay.REFERENCE}', 1), lambda g: string_split(g, ','))), lambda r: trim(r))"
CHUNKS = f"""{SENTENCES},
nn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY i, j) AS r FROM sp),
pk AS (SELECT doc_id, kind, k, r, s, e, w, 1 AS c, w AS tw FROM nn WHERE r = 1
  UNION ALL SELECT n.doc_id, n.kind, n.k, n.r, n.s, n.e, n.w, CASE WHEN p.tw + n.w <= 1000 THEN p.c ELSE p.c + 1 END, CASE WHEN p.tw + n.w <= 1000 THEN p.tw + n.w ELSE n.w END FROM pk p JOIN nn n ON n.doc_id = p.doc_id AND n.kind = p.kind AND n.r = p.r + 1),
cs AS (SELECT doc_id, kind, k, c, min(s) AS s, max(e) AS e FROM pk GROUP BY ALL),
ct AS (SELECT cs.*, g.page_no, g.section_heading, substr(g.raw_text, cs.s + 1, cs.e - cs.s) AS text, row_number() OVER (PARTITION BY cs.doc_id ORDER BY k, c) - 1 AS n FROM cs JOIN pages_ g USING (doc_id)),
ch AS (SELECT doc_id || '__p0001__c' || lpad(CAST(n AS VARCHAR), 2, '0') AS chunk_id, doc_id, page_no, kind, s AS char_start, e AS char_end, text,
  CASE WHEN {_count("text")} < 5 THEN 'too short to hold a claim' WHEN regexp_matches(text, '[0-9]') OR len(regexp_extract_all(text, '(^|[^\\p{{L}}\\p{{N}}_])[A-Z][a-z]{{2,}}(?:$|[^\\p{{L}}\\p{{N}}_])')) >= 2 THEN NULL ELSE 'no numbers and nothing named' END AS why_skipped,
  concat_ws(chr(10), CASE WHEN section_heading <> '' THEN '[SECTION] ' || section_heading END, CASE WHEN kind <> 'footnotes' THEN '[FOOTNOTE *] applies to all' END,
    CASE WHEN kind <> 'footnotes' AND list_contains({_refs}, '1') THEN '[FOOTNOTE 1] note one' END, CASE WHEN kind <> 'footnotes' AND list_contains({_refs}, '5') THEN '[FOOTNOTE 5] note five' END) AS context_header FROM ct)"""

_find = lambda e, x: f"nullif(strpos({x}, {e}), 0) - 1"
_pattern = f"array_to_string(list_transform({words('e')}, lambda w: '\\Q' || w || '\\E'), '{WS}+')"
GROUNDED = f"""cl AS ({adapters.CLAIMS.strip()}), g0 AS (SELECT *, {trim("coalesce(evidence_text, '')")} AS e FROM cl),
g1 AS (SELECT *, length(e) >= 3 AS ok, {_find("e", "chunk_text")} AS xc, {_find("e", "page_text")} AS xp, nullif(regexp_extract(chunk_text, {_pattern}), '') AS mc, nullif(regexp_extract(page_text, {_pattern}), '') AS mp FROM g0),
g2 AS (SELECT *, CASE WHEN NOT ok THEN NULL WHEN xc IS NOT NULL THEN 'exact' WHEN mc IS NOT NULL THEN 'flexible' WHEN xp IS NOT NULL OR mp IS NOT NULL THEN 'same_page' END AS method FROM g1),
gr AS (SELECT fact_id, doc_id, page_no, page_text, method IS NOT NULL AS grounded, method AS grounding_method,
  CAST(CASE method WHEN 'exact' THEN xc + chunk_char_start WHEN 'flexible' THEN {_find("mc", "chunk_text")} + chunk_char_start WHEN 'same_page' THEN coalesce(xp, {_find("mp", "page_text")}) END AS INTEGER) AS char_start,
  CAST(CASE method WHEN 'exact' THEN xc + chunk_char_start + length(e) WHEN 'flexible' THEN {_find("mc", "chunk_text")} + chunk_char_start + length(mc) WHEN 'same_page' THEN CASE WHEN xp IS NOT NULL THEN xp + length(e) ELSE {_find("mp", "page_text")} + length(mp) END END AS INTEGER) AS char_end,
  CASE WHEN ok AND coalesce(value_raw, '') <> '' THEN contains(regexp_replace(lower(e), '(?:{WS}|,)+', '', 'g'), regexp_replace(lower(value_raw), '(?:{WS}|,)+', '', 'g')) ELSE false END AS value_in_evidence FROM g2)"""

LINE_CTE = f"lines AS ({adapters.LINES.strip()})"
#: Lines on more pages, so that there are gutters between them.
SPARSE_LINES = adapters.LINES.replace(adapters.LINE_DOCUMENT, adapters.SPARSE_DOCUMENT).strip()
FLOW = f"""{LINE_CTE}, fl AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY top, "left", line_id) AS pos FROM lines WHERE NOT (font_size <= 9 AND (bottom < page_height * 0.06 OR top > page_height * 0.94)))"""
_mark = lambda i: f"nullif(regexp_extract(text, '{lay.FOOTNOTE}', {i}), '')"
NOTES = f"""{FLOW},
f0 AS (SELECT *, coalesce({_mark(1)}, {_mark(2)}, {_mark(3)}, {_mark(4)}) AS opens FROM fl WHERE top >= page_height * 0.7),
f1 AS (SELECT *, count(opens) OVER (PARTITION BY doc_id, page_no ORDER BY pos) AS island FROM f0),
f2 AS (SELECT *, first_value(font_size) OVER w AS ff, first_value("left") OVER w AS fl_, first_value(opens) OVER w AS marker FROM f1 WHERE island > 0 WINDOW w AS (PARTITION BY doc_id, page_no, island ORDER BY pos)),
f3 AS (SELECT *, min(CASE WHEN abs(font_size - ff) <= 1.5 AND abs("left" - fl_) <= 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no, island ORDER BY pos) AS open_ FROM f2),
fn AS (SELECT doc_id, page_no, pos, line_id, island, marker, CASE WHEN opens IS NOT NULL THEN {trim(f"regexp_extract(text, '{lay.FOOTNOTE}', 5)")} ELSE text END AS said FROM f3 WHERE open_ = 1),
fb AS (SELECT doc_id, page_no, island, marker, string_agg(said, ' ' ORDER BY pos) AS body FROM fn GROUP BY ALL),
nt AS (SELECT doc_id, page_no, marker, arg_max(body, island) AS body FROM fb GROUP BY ALL)"""
_fb = "CAST(floor({x} / (page_width / 200)) AS INTEGER)"
GUTTERS = f"""{FLOW.replace(adapters.LINES.strip(), SPARSE_LINES)},
sl AS (SELECT DISTINCT doc_id, page_no, page_width, unnest(range(greatest(0, {_fb.format(x='"left"')}), least(199, {_fb.format(x='"right"')}) + 1)) AS slice FROM fl),
ga AS (SELECT *, slice - lag(slice) OVER (PARTITION BY doc_id, page_no ORDER BY slice) - 1 AS gap FROM sl),
gu AS (SELECT doc_id, page_no, list(slice * (page_width / 200) ORDER BY slice) AS gutters FROM ga WHERE gap >= 8 GROUP BY ALL)"""
TABLE_CTE = f"raw AS ({adapters.TABLES.replace('{array}', 'list_value').strip()})"
_cells = f"list_transform(cells, lambda c: coalesce({collapse('c')}, ''))"
FLAT = f"""{TABLE_CTE},
t0 AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page_no, table_no) AS n FROM raw),
ft AS (SELECT doc_id, page_no, table_no, row_no, cs AS cells, array_to_string(cs, ' | ') AS line, n FROM (SELECT *, {_cells} AS cs FROM t0) WHERE len(list_filter(cs, lambda c: c <> '')) >= 2)"""
KEPT = f"""{FLOW}, {FLAT},
pz AS (SELECT doc_id, page_no, lower({collapse("string_agg(text, ' ' ORDER BY pos)")}) AS prose FROM fl GROUP BY ALL),
k0 AS (SELECT ft.*, {collapse("replace(line, '|', ' ')")} AS content, coalesce(prose, '') AS prose FROM ft LEFT JOIN pz USING (doc_id, page_no) WHERE n >= 2),
k1 AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page_no, table_no) AS left_over FROM k0 WHERE NOT (length(content) > 20 AND contains(prose, lower(content)))),
kt AS (SELECT doc_id, page_no, table_no, row_no, cells, line FROM k1 WHERE left_over >= 2)"""
