"""Queries on pages, passages, evidence and answers. Importing this module registers them."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from attestor.operators import extraction as ext
from attestor.operators import grounding as gro
from attestor.operators import layout as lay
from attestor.operators import model_calls as calls
from attestor.operators import passages as pas
from attestor.plans import oracle as o
from attestor.plans.registry import query
from attestor.sources import adapters


@query(f"WITH {o.FLOW} SELECT doc_id, page_no, line_id, CAST(pos AS INTEGER) AS pos FROM fl")
def position_sort(spark, sf_dir):
    return lay.ordered(adapters.lines(spark, sf_dir)).select("doc_id", "page_no", "line_id", "pos")


@query(f"WITH {o.FLOW} SELECT doc_id, page_no, count(*) AS n FROM lines WHERE line_id NOT IN (SELECT line_id FROM fl f2 WHERE f2.page_no = lines.page_no) GROUP BY ALL")
def furniture(spark, sf_dir):
    return adapters.lines(spark, sf_dir).where(lay.is_furniture()).groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {o.NOTES} SELECT doc_id, page_no, marker, body FROM nt")
def footnote_bodies(spark, sf_dir):
    return lay.footnotes(lay.footnote_lines(lay.ordered(adapters.lines(spark, sf_dir))))


@query(f"WITH {o.LINE_CTE} SELECT page_no, line_id, array_to_string(list_reduce(list_transform({o._refs}, lambda r: [r]), lambda x, y: CASE WHEN list_contains(x, y[1]) THEN x ELSE list_concat(x, y) END), ',') AS refs FROM lines WHERE regexp_matches(text, '{lay.REFERENCE}')")
def footnote_refs(spark, sf_dir):
    rows = adapters.lines(spark, sf_dir).withColumn("r", lay.references(F.col("text"))).where(F.size("r") > 0)
    return rows.select("page_no", "line_id", F.array_join("r", ",").alias("refs"))


_narrow, _over = 'greatest(1.0, least("right" - "left", pr - pl))', '(least("right", pr) - greatest("left", pl))'


@query(f"""WITH {o.FLOW}, nb AS (SELECT *, lag("left") OVER w AS pl, lag("right") OVER w AS pr, lag(top) OVER w AS pt, lag(bottom) OVER w AS pb FROM fl WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY pos))
SELECT doc_id, page_no, line_id, CASE WHEN {_narrow} <= 45 THEN greatest(0.0, -{_over}) <= 12 ELSE {_over} > 0 AND {_over} / {_narrow} >= 0.25 END AS same_column,
  top - pb <= 0 OR top - pb <= least(pb - pt, bottom - top) + 6 AS "close" FROM nb WHERE pl IS NOT NULL""")
def neighbour_predicates(spark, sf_dir):
    return lay.neighbours(lay.ordered(adapters.lines(spark, sf_dir)))


_box = '{l: "left", r: "right", b: bottom, h: bottom - top}'
_join = '{l: least(x.l, "left"), r: greatest(x.r, "right"), b: greatest(x.b, bottom), h: least(x.h, bottom - top)}'
_slim, _common = 'greatest(1.0, least("right" - "left", x.r - x.l))', '(least("right", x.r) - greatest("left", x.l))'
_meets = f"(CASE WHEN {_slim} <= 45 THEN greatest(0.0, -{_common}) <= 12 ELSE {_common} > 0 AND {_common} / {_slim} >= 0.25 END) AND (top - x.b <= 0 OR top - x.b <= least(x.h, bottom - top) + 6)"




def _blocks(lines: str, name: str = "bk") -> str:
    """CTE of the blocks of lines (with rpos from 1 on each page) as a recursion from line to line."""
    return f"""{name} AS (SELECT doc_id, page_no, pos, rpos, 0 AS block, [{_box}] AS bs FROM {lines} WHERE rpos = 1
  UNION ALL SELECT doc_id, page_no, pos, rpos, coalesce(found, len(bs)), CASE WHEN found IS NULL THEN list_append(bs, {_box}) ELSE list_transform(bs, lambda x, i: CASE WHEN i = found + 1 THEN {_join} ELSE x END) END
    FROM (SELECT l.*, bs, list_sort(list_filter(list_transform(bs, lambda x, i: CASE WHEN {_meets} THEN {{gap: top - x.b, i: i - 1}} END), lambda y: y IS NOT NULL))[1].i AS found FROM {name} b JOIN {lines} l ON l.doc_id = b.doc_id AND l.page_no = b.page_no AND l.rpos = b.rpos + 1))"""


@query(f"""WITH RECURSIVE {o.FLOW}, rl AS (SELECT *, pos AS rpos FROM fl), {_blocks("rl")}
SELECT doc_id, page_no, CAST(pos AS INTEGER) AS pos, CAST(block AS INTEGER) AS block FROM bk""")
def block_grouping(spark, sf_dir):
    return lay.blocks(lay.ordered(adapters.lines(spark, sf_dir)))


@query(f"WITH {o.GUTTERS} SELECT doc_id, page_no, array_to_string(list_transform(gutters, lambda g: CAST(round(g, 2) AS VARCHAR)), ',') AS gutters FROM gu")
def gutters(spark, sf_dir):
    found = lay.gutters(lay.ordered(adapters.sparse_lines(spark, sf_dir)))
    return found.select("doc_id", "page_no", F.array_join(F.transform("gutters", lambda g: F.round(g, 2).cast("string")), ",").alias("gutters"))


@query(f"""WITH {o.GUTTERS}, cl AS (SELECT fl.*, CASE WHEN coalesce(len(gutters), 0) + 1 BETWEEN 2 AND 4 THEN len(list_filter(gutters, lambda g: "left" >= g)) ELSE 0 END AS col FROM fl LEFT JOIN gu USING (doc_id, page_no))
SELECT doc_id, page_no, line_id, CAST(col AS INTEGER) AS "column", CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY col, top, "left", line_id) AS INTEGER) AS place FROM cl""")
def reading_order(spark, sf_dir):
    return lay.reading_order(lay.ordered(adapters.sparse_lines(spark, sf_dir)), "line_id").select("doc_id", "page_no", "line_id", "column", "place")


@query(f"""WITH {o.FLOW}, st AS (SELECT doc_id, page_no, list_sort(list(font_size))[len(list(font_size)) // 2 + 1] AS body, max(bottom) AS deepest FROM fl GROUP BY ALL),
hd AS (SELECT doc_id, page_no, first(text ORDER BY font_size DESC, top, line_id) AS heading FROM fl JOIN st USING (doc_id, page_no) WHERE deepest > 0 AND font_size >= body * 1.4 AND top <= deepest * 0.35 GROUP BY ALL)
SELECT doc_id, page_no, coalesce(heading, '') AS heading FROM st LEFT JOIN hd USING (doc_id, page_no)""")
def headings(spark, sf_dir):
    return lay.headings(lay.ordered(adapters.lines(spark, sf_dir)))


@query(f"WITH {o.FLAT} SELECT doc_id, page_no, table_no, row_no, line FROM ft")
def flatten_tables(spark, sf_dir):
    return lay.flattened(adapters.raw_tables(spark, sf_dir)).select("doc_id", "page_no", "table_no", "row_no", "line")


def _prose(spark, sf_dir):
    lines = lay.ordered(adapters.lines(spark, sf_dir))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), " ")
    return lines, lines.groupBy("doc_id", "page_no").agg(text.alias("text"))


@query(f"WITH {o.KEPT} SELECT doc_id, page_no, table_no, row_no, line FROM kt")
def kept_tables(spark, sf_dir):
    _, prose = _prose(spark, sf_dir)
    return lay.kept_tables(adapters.raw_tables(spark, sf_dir), prose).select("doc_id", "page_no", "table_no", "row_no", "line")


@query(f"WITH {o.KEPT}, ce AS (SELECT DISTINCT doc_id, page_no, lower(cell) AS cell FROM (SELECT doc_id, page_no, unnest(cells) AS cell FROM kt) WHERE cell <> '') SELECT doc_id, page_no, line_id FROM fl ANTI JOIN ce ON fl.doc_id = ce.doc_id AND fl.page_no = ce.page_no AND lower(fl.text) = ce.cell")
def table_antijoin(spark, sf_dir):
    lines, prose = _prose(spark, sf_dir)
    return lay.without_table_lines(lines, lay.kept_tables(adapters.raw_tables(spark, sf_dir), prose)).select("doc_id", "page_no", "line_id")


@query(f"""WITH {o.NOTES}, {o.FLAT + o.KEPT.split(o.FLAT)[1]},
pa AS (SELECT doc_id, page_no, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS p FROM fl GROUP BY ALL),
tt AS (SELECT doc_id, page_no, table_no, 'TABLE ' || table_no || chr(10) || string_agg(line, chr(10) ORDER BY row_no) AS t FROM kt GROUP BY doc_id, page_no, table_no),
ta AS (SELECT doc_id, page_no, string_agg(t, chr(10) || chr(10) ORDER BY table_no) AS t FROM tt GROUP BY ALL),
na AS (SELECT doc_id, page_no, string_agg('(' || marker || ') ' || body, chr(10) ORDER BY marker) AS n FROM nt GROUP BY ALL),
al AS (SELECT doc_id, page_no FROM pa UNION SELECT doc_id, page_no FROM ta UNION SELECT doc_id, page_no FROM na)
SELECT doc_id, page_no, concat_ws(chr(10) || chr(10), CASE WHEN trim(p) <> '' THEN p END, '{lay.TABLES_MARK}' || chr(10) || t, '{lay.FOOTNOTES_MARK}' || chr(10) || n) AS raw_text
FROM al LEFT JOIN pa USING (doc_id, page_no) LEFT JOIN ta USING (doc_id, page_no) LEFT JOIN na USING (doc_id, page_no)""")
def page_assembly(spark, sf_dir):
    lines, prose = _prose(spark, sf_dir)
    notes = lay.footnotes(lay.footnote_lines(lines))
    return lay.page_texts(lines.select("doc_id", "page_no", F.col("pos").alias("place"), "text"), lay.kept_tables(adapters.raw_tables(spark, sf_dir), prose), notes)


def ingested(spark, sf_dir):
    return lay.ingested(adapters.lines(spark, sf_dir), adapters.raw_tables(spark, sf_dir))


_SLICE = "CAST(floor({x} / (page_width / 200)) AS INTEGER)"
_KEPT = o.KEPT.split(o.FLAT)[1].replace("pz AS (SELECT doc_id, page_no, lower(" + o.collapse("string_agg(text, ' ' ORDER BY pos)") + ") AS prose FROM fl GROUP BY ALL)", "pz AS (SELECT doc_id, page_no, lower(" + o.collapse("string_agg(text, ' ' ORDER BY block)") + ") AS prose FROM bt GROUP BY ALL)")
_TEXTS = "string_agg(text, chr(10) ORDER BY pos) AS text, min(\"left\") AS \"left\", max(\"right\") AS \"right\", min(top) AS top, max(page_width) AS page_width"
#: The whole chain from lines and raw tables to pages, as CTE ig.
INGESTED = f"""{o.NOTES},
pr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY pos) AS rpos FROM fl ANTI JOIN fn USING (doc_id, page_no, pos)), {_blocks("pr")},
pb AS (SELECT pr.*, block FROM pr JOIN bk USING (doc_id, page_no, pos)),
bt AS (SELECT doc_id, page_no, block, {_TEXTS} FROM pb GROUP BY ALL), {o.FLAT + _KEPT},
ce AS (SELECT DISTINCT doc_id, page_no, lower(cell) AS cell FROM (SELECT doc_id, page_no, unnest(cells) AS cell FROM kt) WHERE cell <> ''),
lt AS (SELECT pb.* FROM pb ANTI JOIN ce ON pb.doc_id = ce.doc_id AND pb.page_no = ce.page_no AND lower(pb.text) = ce.cell),
sh AS (SELECT doc_id, page_no, block, {_TEXTS} FROM lt GROUP BY ALL),
sl AS (SELECT DISTINCT doc_id, page_no, page_width, unnest(range(greatest(0, {_SLICE.format(x='"left"')}), least(199, {_SLICE.format(x='"right"')}) + 1)) AS slice FROM sh),
ga AS (SELECT *, slice - lag(slice) OVER (PARTITION BY doc_id, page_no ORDER BY slice) - 1 AS gap FROM sl),
gu AS (SELECT doc_id, page_no, list(slice * (page_width / 200) ORDER BY slice) AS gutters FROM ga WHERE gap >= 8 GROUP BY ALL),
cl AS (SELECT sh.*, CASE WHEN coalesce(len(gutters), 0) + 1 BETWEEN 2 AND 4 THEN len(list_filter(gutters, lambda g: "left" >= g)) ELSE 0 END AS col FROM sh LEFT JOIN gu USING (doc_id, page_no)),
pa AS (SELECT doc_id, page_no, string_agg(text, chr(10) || chr(10) ORDER BY col, top, "left", block) AS p FROM cl GROUP BY ALL),
tt AS (SELECT doc_id, page_no, table_no, 'TABLE ' || table_no || chr(10) || string_agg(line, chr(10) ORDER BY row_no) AS t FROM kt GROUP BY doc_id, page_no, table_no),
ta AS (SELECT doc_id, page_no, string_agg(t, chr(10) || chr(10) ORDER BY table_no) AS t FROM tt GROUP BY ALL),
na AS (SELECT doc_id, page_no, string_agg('(' || marker || ') ' || body, chr(10) ORDER BY marker) AS n, '{{' || string_agg('"' || marker || '":"' || body || '"', ',' ORDER BY marker) || '}}' AS footnotes FROM nt GROUP BY ALL),
st AS (SELECT doc_id, page_no, list_sort(list(font_size))[len(list(font_size)) // 2 + 1] AS body, max(bottom) AS deepest FROM fl GROUP BY ALL),
hd AS (SELECT doc_id, page_no, first(text ORDER BY font_size DESC, top, line_id) AS heading FROM fl JOIN st USING (doc_id, page_no) WHERE deepest > 0 AND font_size >= body * 1.4 AND top <= deepest * 0.35 GROUP BY ALL),
al AS (SELECT doc_id, page_no FROM pa UNION SELECT doc_id, page_no FROM ta UNION SELECT doc_id, page_no FROM na),
ig AS (SELECT doc_id, page_no, concat_ws(chr(10) || chr(10), CASE WHEN trim(p) <> '' THEN p END, '{lay.TABLES_MARK}' || chr(10) || t, '{lay.FOOTNOTES_MARK}' || chr(10) || n) AS raw_text, coalesce(heading, '') AS section_heading, coalesce(footnotes, '{{}}') AS footnotes
  FROM al LEFT JOIN pa USING (doc_id, page_no) LEFT JOIN ta USING (doc_id, page_no) LEFT JOIN na USING (doc_id, page_no) LEFT JOIN hd USING (doc_id, page_no))"""


@query(f"WITH RECURSIVE {INGESTED} SELECT doc_id, page_no, raw_text, section_heading, footnotes FROM ig")
def ingest_pages(spark, sf_dir):
    return ingested(spark, sf_dir).withColumn("footnotes", F.to_json("footnotes"))


@query(f"""WITH RECURSIVE {INGESTED} SELECT doc_id, count(*) AS pages, CAST(sum(length(raw_text)) AS BIGINT) AS characters, count(*) FILTER (WHERE contains(raw_text, '{lay.TABLES_MARK}')) AS with_tables,
  count(*) FILTER (WHERE contains(raw_text, '{lay.FOOTNOTES_MARK}')) AS with_footnotes, coalesce(string_agg(CAST(page_no AS VARCHAR), ',' ORDER BY page_no) FILTER (WHERE length(raw_text) < 100), '') AS nearly_empty FROM ig GROUP BY doc_id""")
def ingest_summary(spark, sf_dir):
    return lay.document_summary(ingested(spark, sf_dir))


@query(f"WITH {o.REGIONS} SELECT doc_id, kind, CAST(s AS INTEGER) AS \"start\", CAST(e AS INTEGER) AS \"end\" FROM rg")
def regions(spark, sf_dir):
    return pas.region_rows(adapters.pages(spark, sf_dir)).select("doc_id", "kind", "start", "end")


@query(f"WITH {o.PARAGRAPHS} SELECT doc_id, kind, s AS \"start\", e AS \"end\", w AS words FROM pp")
def paragraphs(spark, sf_dir):
    rows = pas.region_rows(adapters.pages(spark, sf_dir))
    return rows.select("doc_id", "kind", F.explode(pas.paragraphs(F.col("raw_text"), F.col("start"), F.col("end"))).alias("p")).select("doc_id", "kind", "p.*")


@query(f"WITH {o.SENTENCES} SELECT doc_id, kind, s AS \"start\", e AS \"end\", w AS words FROM sp")
def sentences(spark, sf_dir):
    rows, text = pas.region_rows(adapters.pages(spark, sf_dir)), F.col("raw_text")
    return rows.select("doc_id", "kind", F.explode(pas.broken(text, pas.paragraphs(text, F.col("start"), F.col("end")))).alias("p")).select("doc_id", "kind", "p.*")


def chunks(spark, sf_dir):
    return pas.chunks(adapters.pages(spark, sf_dir))


@query(f"WITH RECURSIVE {o.CHUNKS} SELECT chunk_id, kind, char_start, char_end, sha256(text) AS text_sha256 FROM ch")
def packed_chunks(spark, sf_dir):
    return chunks(spark, sf_dir).select("chunk_id", "kind", "char_start", "char_end", F.sha2("text", 256).alias("text_sha256"))


@query(f"WITH RECURSIVE {o.CHUNKS} SELECT chunk_id, context_header FROM ch")
def context_headers(spark, sf_dir):
    return chunks(spark, sf_dir).select("chunk_id", "context_header")


@query(f"WITH RECURSIVE {o.CHUNKS} SELECT chunk_id, why_skipped FROM ch")
def prefilter(spark, sf_dir):
    return chunks(spark, sf_dir).select("chunk_id", "why_skipped")


@query(f"WITH RECURSIVE {o.CHUNKS} SELECT kind, count(*) AS n, CAST(floor(median({o._count('text')})) AS BIGINT) AS median_words, CAST(max({o._count('text')}) AS INTEGER) AS most_words, count(*) FILTER (WHERE why_skipped IS NULL) AS sent FROM ch GROUP BY kind")
def chunk_stats(spark, sf_dir):
    return pas.statistics(chunks(spark, sf_dir))


@query(f"WITH RECURSIVE {o.CHUNKS}, sh AS (SELECT ch.*, raw_text, CASE WHEN CAST(substr(doc_id, 5) AS BIGINT) % 4 = 0 THEN 1 ELSE 0 END AS off FROM ch JOIN pages_ USING (doc_id)) SELECT chunk_id FROM sh WHERE substr(raw_text, char_start + 1 + off, char_end - char_start - off) <> text")
def offset_audit(spark, sf_dir):
    """The audit over chunks of which every fourth document's begin one character late."""
    pages = adapters.pages(spark, sf_dir)
    late = (F.substring("doc_id", 5, 20).cast("long") % 4 == 0).cast("int")
    return pas.misplaced(pas.chunks(pages).withColumn("char_start", F.col("char_start") + late), pages)


@query(f"WITH RECURSIVE {o.CHUNKS} (SELECT chunk_id, kind FROM ch WHERE context_header LIKE '%[FOOTNOTE%' ORDER BY length(context_header) DESC, chunk_id LIMIT 1) UNION ALL (SELECT chunk_id, kind FROM ch WHERE kind = 'table' ORDER BY length(text) DESC, chunk_id LIMIT 1)")
def exemplars(spark, sf_dir):
    return pas.exemplars(chunks(spark, sf_dir))


def grounded(spark, sf_dir):
    return gro.grounded(adapters.claims(spark, sf_dir))


@query(f"WITH {o.GROUNDED} SELECT fact_id, grounded, grounding_method, char_start, char_end FROM gr")
def ground_claims(spark, sf_dir):
    return grounded(spark, sf_dir).select("fact_id", "grounded", "grounding_method", "char_start", "char_end")


@query(f"WITH {o.GROUNDED} SELECT fact_id, value_in_evidence FROM gr")
def value_in_evidence(spark, sf_dir):
    return grounded(spark, sf_dir).select("fact_id", "value_in_evidence")


@query(f"WITH {o.GROUNDED} SELECT grounding_method, count(*) AS n, count(*) FILTER (WHERE value_in_evidence) AS with_value FROM gr GROUP BY 1")
def grounding_stats(spark, sf_dir):
    return gro.statistics(grounded(spark, sf_dir))


@query(f"WITH {o.GROUNDED} SELECT 'ground' AS stage, 'not_grounded' AS kind, fact_id FROM gr WHERE NOT grounded")
def grounding_rejections(spark, sf_dir):
    return gro.rejections(grounded(spark, sf_dir)).drop("detail")


@query(f"WITH {o.GROUNDED} SELECT fact_id, substr(page_text, greatest(char_start - 500, 0) + 1, char_start - greatest(char_start - 500, 0)) AS before, substr(page_text, char_start + 1, char_end - char_start) AS quote, substr(page_text, char_end + 1, 500) AS after FROM gr WHERE char_start IS NOT NULL")
def evidence_window(spark, sf_dir):
    from attestor.operators import reads

    claims = grounded(spark, sf_dir)
    pages = adapters.claims(spark, sf_dir).select("doc_id", "page_no", F.col("page_text").alias("raw_text"))
    return reads.evidence_window(claims, pages)


_REQUESTS = f"""{o.CHUNKS},
cw AS (SELECT *, CAST({o._count("text")} AS INTEGER) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) AS r FROM ch WHERE why_skipped IS NULL),
rq AS (SELECT doc_id, chunk_id, r, w, 0 AS q, w AS tw, 1 AS m FROM cw WHERE r = 1
  UNION ALL SELECT c.doc_id, c.chunk_id, c.r, c.w, CASE WHEN p.tw + c.w > {ext.REQUEST_WORDS} OR p.m >= {ext.REQUEST_PASSAGES} THEN p.q + 1 ELSE p.q END, CASE WHEN p.tw + c.w > {ext.REQUEST_WORDS} OR p.m >= {ext.REQUEST_PASSAGES} THEN c.w ELSE p.tw + c.w END, CASE WHEN p.tw + c.w > {ext.REQUEST_WORDS} OR p.m >= {ext.REQUEST_PASSAGES} THEN 1 ELSE p.m + 1 END FROM rq p JOIN cw c ON c.doc_id = p.doc_id AND c.r = p.r + 1),
rs AS (SELECT doc_id || '__r' || lpad(CAST(q AS VARCHAR), 4, '0') AS request_id, doc_id, string_agg(chunk_id, ',' ORDER BY r) AS chunk_ids, sha256('Extract claims.' || chr(10) || chr(10) || string_agg('=== PASSAGE ' || chunk_id || ' ===' || chr(10) || CASE WHEN context_header <> '' THEN context_header || chr(10) ELSE '' END || text, chr(10) || chr(10) ORDER BY chunk_id)) AS prompt_sha256 FROM rq JOIN ch USING (doc_id, chunk_id) GROUP BY doc_id, q)"""


@query(f"WITH RECURSIVE {_REQUESTS} SELECT request_id, doc_id, chunk_ids FROM rs")
def pack_requests(spark, sf_dir):
    return ext.packed(chunks(spark, sf_dir)).withColumn("chunk_ids", F.array_join("chunk_ids", ","))


@query(f"WITH RECURSIVE {_REQUESTS} SELECT request_id, doc_id, prompt_sha256 FROM rs")
def request_prompts(spark, sf_dir):
    made = chunks(spark, sf_dir)
    return ext.prompts(ext.packed(made), made, "Extract claims.").select("request_id", "doc_id", F.sha2("prompt", 256).alias("prompt_sha256"))


@query(f"WITH RECURSIVE {_REQUESTS}, ky AS (SELECT request_id, sha256('v1' || chr(10) || '---' || chr(10) || 'm' || chr(10) || '---' || chr(10) || prompt_sha256) AS key FROM rs) SELECT request_id, key FROM ky WHERE NOT ends_with(request_id, '0__r0000')")
def cache_misses(spark, sf_dir):
    """Requests of documents whose number ends in 0 stand in the cache."""
    keyed = request_prompts(spark, sf_dir).select("request_id", ext.cache_key(F.lit("v1"), F.lit("m"), F.col("prompt_sha256")).alias("key"))
    return ext.cache_misses(keyed, keyed.where(F.col("request_id").endswith("0__r0000")))


@query(f"""WITH RECURSIVE {_REQUESTS} SELECT request_id, doc_id, CASE WHEN NOT starts_with(prompt_sha256, '0') AND NOT starts_with(prompt_sha256, '1') THEN '{{"facts": [], "of": "' || prompt_sha256 || '"}}' END AS answer,
  CASE WHEN starts_with(prompt_sha256, '0') THEN 'the model gave no answer' WHEN starts_with(prompt_sha256, '1') THEN 'refused' END AS error FROM rs""")
def model_answers(spark, sf_dir):
    """Answers of a deterministic provider in place of a model, which gives none to some prompts and fails on others."""
    made = chunks(spark, sf_dir)

    def provider(prompt: str) -> str | None:
        own = hashlib.sha256(prompt.encode()).hexdigest()
        if own[0] == "1":
            raise ValueError("refused")
        return None if own[0] == "0" else f'{{"facts": [], "of": "{own}"}}'

    return calls.paced(ext.prompts(ext.packed(made), made, "Extract claims."), provider, 1e6)


_COMPLAINT = """CASE WHEN event_id % 13 = 0 THEN 'answer is not JSON' WHEN event_id % 17 = 0 THEN 'value_raw is missing' WHEN user_id % 4 = 3 AND event_id % 7 = 0 THEN 'value_kind is not known' WHEN event_id % 19 = 0 THEN 'source_kind is not known' END"""
_CLAIMS = f"cx AS (SELECT *, {_COMPLAINT} AS complaint, 'c' || event_id % 50 AS chunk_id FROM events)"


@query(f"WITH {_CLAIMS} SELECT 'r' || event_id AS request_id, complaint, CASE WHEN event_id % 13 <> 0 THEN 'user ' || user_id END AS subject, CASE WHEN event_id % 13 <> 0 AND event_id % 17 <> 0 THEN event_id || ' mn' END AS value_raw, CASE WHEN event_id % 13 <> 0 AND event_id % 2 = 1 THEN 'mn' END AS unit, CASE WHEN event_id % 13 <> 0 AND event_id % 4 = 0 THEN 'standalone' END AS scope FROM cx")
def validate_claims(spark, sf_dir):
    return ext.parsed(adapters.answers(spark, sf_dir)).select("request_id", "complaint", "subject", "value_raw", "unit", "scope")


def _sent(spark, sf_dir):
    """Requests with the passage that each claim names, but for every sixth; passages of three kinds."""
    events = adapters.table(spark, sf_dir, "events").select("event_id")
    own = F.concat(F.lit("c"), (F.col("event_id") % 50).cast("string"))
    requests = events.select(F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("request_id"), F.array(F.when(F.col("event_id") % 6 == 0, "c99").otherwise(own)).alias("chunk_ids"))
    kind = F.element_at(F.array(F.lit("prose"), F.lit("table"), F.lit("footnotes")), (F.col("id") % 3 + 1).cast("int"))
    passages = spark.range(50).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk_id"), F.lit("doc_0").alias("doc_id"), F.lit(1).alias("page_no"), kind.alias("kind"))
    return requests, passages


_KIND = "CASE event_id % 50 % 3 WHEN 1 THEN 'table_row' WHEN 2 THEN 'footnote' ELSE 'prose' END"


@query(f"WITH {_CLAIMS} SELECT chunk_id || '__f00' AS fact_id, event_type AS attribute_raw, {_KIND} AS source_kind, CASE event_id % 50 % 3 WHEN 1 THEN CAST(0.75 AS DOUBLE) WHEN 2 THEN 0.85 ELSE 0.9 END AS confidence, CASE WHEN user_id % 4 = 0 THEN event_id || ' mn' WHEN user_id % 4 = 1 THEN event_id || ' mn' END AS value_text FROM cx WHERE complaint IS NULL AND event_id % 6 <> 0")
def attribute_claims(spark, sf_dir):
    requests, passages = _sent(spark, sf_dir)
    return ext.attributed(ext.parsed(adapters.answers(spark, sf_dir)), requests, passages).select("fact_id", "attribute_raw", "source_kind", "confidence", "value_text")


@query(f"WITH {_CLAIMS} SELECT 'r' || event_id AS request_id, chunk_id, 0 AS position FROM cx WHERE complaint IS NULL AND event_id % 6 = 0")
def misattributed_claims(spark, sf_dir):
    return ext.misattributed(ext.parsed(adapters.answers(spark, sf_dir)), _sent(spark, sf_dir)[0])


@query(f"WITH {_CLAIMS} SELECT {_KIND} AS source_kind, count(*) AS n, count(*) FILTER (WHERE user_id % 3 = 0) AS with_period, count(*) FILTER (WHERE event_id % 3 = 1) AS with_as_of, count(*) FILTER (WHERE event_id % 4 = 0) AS with_scope, count(*) AS with_subject FROM cx WHERE complaint IS NULL AND event_id % 6 <> 0 GROUP BY 1")
def fill_rates(spark, sf_dir):
    requests, passages = _sent(spark, sf_dir)
    return ext.fill_rates(ext.attributed(ext.parsed(adapters.answers(spark, sf_dir)), requests, passages))
