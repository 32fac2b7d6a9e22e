"""Queries on entities, families, searches, cases, dashboards and stored tables. Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions.similarity import register, token_sort_ratio_native
from attestor.functions.text import readable_id
from attestor.operators import passages as pas
from attestor.operators import reads
from attestor.operators import resolution as res
from attestor.plans import oracle as o
from attestor.plans.registry import normalised, query, relations
from attestor.sources import adapters, files, tables


def facts(spark, sf_dir):
    return adapters.facts(spark, sf_dir)


@query(f"WITH {o.FACT_CTE} SELECT fact_id, {o.simple_name('subject_raw')} AS name, {o.plain('attribute_raw')} AS attribute FROM facts")
def simplify_names(spark, sf_dir):
    return facts(spark, sf_dir).select("fact_id", res.simple_name(F.col("subject_raw")).alias("name"), res.simple_attribute(F.col("attribute_raw")).alias("attribute"))


@query(f"WITH {o.FACT_CTE} SELECT fact_id, {o.self_reference('subject_raw')} AS self_reference FROM facts")
def self_reference(spark, sf_dir):
    return facts(spark, sf_dir).select("fact_id", res.is_self_reference(F.col("subject_raw")).alias("self_reference"))


@query("SELECT doc_id, array_to_string(list_sort(list_transform(list_distinct(list_transform(m, lambda x: x.l)), lambda k: k || '=' || list_last(list_filter(m, lambda x: x.l = k)).c)), ';') AS identifiers FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(t, '\\b([A-Z]{2,6})\\s*[:\\-]?\\s*([A-Z0-9]{6,25})\\b'), lambda x: {'l': regexp_extract(x, '^[A-Z]{2,6}'), 'c': regexp_extract(x, '[A-Z0-9]{6,25}$')}), lambda y: regexp_matches(y.c, '[0-9]')) AS m FROM (SELECT doc_id, 'CIN: A' || (1000000 + doc_id) || ' and DIN - ' || (2000000 + doc_id % 7) || CASE WHEN doc_id % 2 = 0 THEN ' CIN: B' || (3000000 + doc_id) ELSE ' REG ABCDEFGH' END AS t FROM documents))")
def identifiers(spark, sf_dir):
    n = F.col("doc_id")
    tail = F.when(n % 2 == 0, F.concat(F.lit(" CIN: B"), (n + 3000000).cast("string"))).otherwise(" REG ABCDEFGH")
    text = F.concat(F.lit("CIN: A"), (n + 1000000).cast("string"), F.lit(" and DIN - "), (n % 7 + 2000000).cast("string"), tail)
    found = adapters.table(spark, sf_dir, "documents").select("doc_id", res.identifiers(text).alias("m"))
    return found.select("doc_id", F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("identifiers"))


@query(f"SELECT p_partkey, {o.readable_id('fam', 'p_name')} AS id FROM part")
def readable_ids(spark, sf_dir):
    return adapters.table(spark, sf_dir, "part").select("p_partkey", readable_id("fam", F.col("p_name")).alias("id"))


@query(f"WITH {o.FACT_CTE} SELECT fact_id, array_to_string({o.tags('scope_raw')}, ' ') AS tags FROM facts")
def scope_tags(spark, sf_dir):
    return facts(spark, sf_dir).select("fact_id", F.array_join(res.scope_tags(F.col("scope_raw")), " ").alias("tags"))


@query(f"WITH {o.FACT_CTE} SELECT fact_id, array_to_string({o.signature('attribute_raw')}, ' ') AS signature FROM facts")
def measure_signature(spark, sf_dir):
    return facts(spark, sf_dir).select("fact_id", F.array_join(res.signature(F.col("attribute_raw")), " ").alias("signature"))


_MAIN = f"mn AS (SELECT doc_id, {o.simple_name('subject_raw')} AS name, count(*) AS n, min(fact_id) AS first FROM facts WHERE NOT {o.self_reference('subject_raw')} GROUP BY ALL), ms AS (SELECT doc_id, arg_min(name, (-n, first)) AS main_subject FROM mn WHERE name <> '' GROUP BY doc_id)"
_SUBJECT = f"{_MAIN}, sj AS (SELECT f.*, CASE WHEN {o.self_reference('subject_raw')} THEN main_subject ELSE {o.simple_name('subject_raw')} END AS subject FROM facts f LEFT JOIN ms USING (doc_id))"


@query(f"WITH {o.FACT_CTE}, {_MAIN} SELECT doc_id, main_subject FROM ms")
def main_subject(spark, sf_dir):
    return res.main_subjects(facts(spark, sf_dir))


@query(f"WITH {o.FACT_CTE}, {_SUBJECT} SELECT fact_id, subject FROM sj")
def resolve_subjects(spark, sf_dir):
    return res.resolved_subjects(facts(spark, sf_dir)).select("fact_id", "subject")


@query(f"""WITH {o.FACT_CTE}, {_SUBJECT},
sp AS (SELECT subject AS leader, CASE WHEN NOT {o.self_reference('subject_raw')} THEN subject_raw END AS spelling, count(*) AS n, min(fact_id) AS first FROM sj GROUP BY ALL)
SELECT {o.readable_id('ent', 'leader')} AS entity_id, coalesce(first(spelling ORDER BY CASE WHEN spelling IS NULL THEN 1 ELSE 0 END, n DESC, first), leader) AS canonical_name, array_to_string(list_sort(list(spelling) FILTER (WHERE spelling IS NOT NULL)), ',') AS aliases, CAST(sum(n) AS BIGINT) AS n_facts FROM sp GROUP BY leader""")
def entities_rollup(spark, sf_dir):
    named = res.resolved_subjects(facts(spark, sf_dir)).withColumn("leader", F.col("subject"))
    return res.entities(named).select("entity_id", "canonical_name", F.array_join("aliases", ",").alias("aliases"), "n_facts")


@query(f"WITH {o.FACT_CTE}, mp AS (SELECT DISTINCT {o.plain('attribute_raw')} AS phrase, array_to_string({o.signature('attribute_raw')}, ' ') AS label FROM facts) SELECT {o.readable_id('fam', 'label')} AS family_id, label, string_agg(phrase, ',' ORDER BY phrase) AS member_phrases FROM mp GROUP BY label")
def family_rollup(spark, sf_dir):
    phrase = facts(spark, sf_dir).select(res.simple_attribute(F.col("attribute_raw")).alias("phrase"))
    return res.family_rows(phrase.withColumn("label", F.array_join(res.signature(F.col("phrase")), " "))).withColumn("member_phrases", F.array_join("member_phrases", ","))


def _leaders(least: float, count: int) -> str:
    """CTEs from names (phrase, n, first, blk) to ld (phrase, leader, leads): scores of all pairs of a block, then one phrase after the other."""
    return f"""ph AS (SELECT *, row_number() OVER (ORDER BY n DESC, first) AS r, array_to_string(list_sort(list_filter(string_split(phrase, ' '), lambda w: w <> '')), ' ') AS t FROM names),
lc AS (SELECT a.r AS l, b.r AS r, a.t AS x, b.t AS y, 0 AS i, list_transform(range(length(b.t) + 1), lambda k: 0) AS row FROM ph a JOIN ph b ON a.r < b.r AND a.blk = b.blk
  UNION ALL SELECT l, r, x, y, i + 1, list_reduce(list_transform(range(1, length(y) + 1), lambda j: [j]), lambda acc, j: list_append(acc, CASE WHEN substr(y, j[1], 1) = substr(x, i + 1, 1) THEN row[j[1]] + 1 ELSE greatest(row[j[1] + 1], acc[len(acc)]) END), [0]) FROM lc WHERE i < length(x)),
sc AS (SELECT r, list({{o: -s, l: l}}) AS near FROM (SELECT l, r, 200.0 * row[len(row)] / (length(x) + length(y)) AS s FROM lc WHERE i = length(x)) WHERE s >= {least} GROUP BY r),
ld AS (SELECT r, phrase, r AS own, n >= {count} AS leads, CASE WHEN n >= {count} THEN [r] ELSE [] END AS ls FROM ph WHERE r = 1
  UNION ALL SELECT r, phrase, coalesce(best, r), best IS NULL AND n >= {count}, CASE WHEN best IS NULL AND n >= {count} THEN list_append(ls, r) ELSE ls END
    FROM (SELECT ph.r, ph.phrase, ph.n, d.ls, list_sort(list_filter(coalesce(near, []), lambda z: list_contains(d.ls, z.l)))[1].l AS best FROM ld d JOIN ph ON ph.r = d.r + 1 LEFT JOIN sc ON sc.r = ph.r))"""


@query(f"WITH RECURSIVE {o.FACT_CTE}, {_SUBJECT}, names AS (SELECT subject AS phrase, count(*) AS n, min(fact_id) AS first, '' AS blk FROM sj GROUP BY subject), {_leaders(93.0, 1)} SELECT ld.phrase, ph.phrase AS leader, leads FROM ld JOIN ph ON ph.r = ld.own")
def leader_entities(spark, sf_dir):
    return res.entity_leaders(res.resolved_subjects(facts(spark, sf_dir)))


@query(f"WITH RECURSIVE {o.FACT_CTE}, names AS (SELECT phrase, count(*) AS n, min(fact_id) AS first, array_to_string({o.signature('phrase')}, ' ') AS blk FROM (SELECT fact_id, {o.plain('attribute_raw')} AS phrase FROM facts) GROUP BY phrase), {_leaders(88.0, 2)} SELECT ld.phrase, ph.phrase AS leader, leads FROM ld JOIN ph ON ph.r = ld.own")
def leader_families(spark, sf_dir):
    return res.family_leaders(facts(spark, sf_dir))


@query(f"WITH {o.FACT_CTE}, fs AS (SELECT attribute_family AS label, count(*) AS n FROM facts GROUP BY 1) SELECT label, CASE WHEN label IN ('A', 'N') THEN (SELECT label FROM fs WHERE label IN ('A', 'N') ORDER BY n DESC, label DESC LIMIT 1) ELSE label END AS final_label FROM fs")
def semantic_merge(spark, sf_dir):
    """A provider that merges A and N under a label that nobody knows."""
    sizes = facts(spark, sf_dir).groupBy(F.col("attribute_family").alias("label")).agg(F.count(F.lit(1)).alias("n_facts"))
    groups = spark.createDataFrame([("unknown", ["A", "N", "missing"])], "canonical string, members array<string>")
    return res.semantic_merge(sizes, groups)


_NAMES = "SELECT DISTINCT p_name AS n FROM part"


_SCORES = f"""WITH RECURSIVE nm AS ({_NAMES}), pq AS (SELECT a.n AS a, b.n AS b, array_to_string(list_sort(string_split(a.n, ' ')), ' ') AS x, array_to_string(list_sort(string_split(b.n, ' ')), ' ') AS y FROM nm a JOIN nm b ON a.n < b.n WHERE substr(a.n, 1, 1) = substr(b.n, 1, 1)),
lc AS (SELECT a, b, x, y, 0 AS i, list_transform(range(length(y) + 1), lambda k: 0) AS r FROM pq
  UNION ALL SELECT a, b, x, y, i + 1, list_reduce(list_transform(range(1, length(y) + 1), lambda j: [j]), lambda acc, j: list_append(acc, CASE WHEN substr(y, j[1], 1) = substr(x, i + 1, 1) THEN r[j[1]] + 1 ELSE greatest(r[j[1] + 1], acc[len(acc)]) END), [0]) FROM lc WHERE i < length(x))
SELECT a, b, round(200.0 * r[len(r)] / (length(x) + length(y)), 6) AS score FROM lc WHERE i = length(x)"""


def _name_pairs(spark, sf_dir):
    names = adapters.table(spark, sf_dir, "part").select(F.col("p_name").alias("a")).distinct()
    return names.join(names.withColumnRenamed("a", "b"), (F.substring("a", 1, 1) == F.substring("b", 1, 1)) & (F.col("a") < F.col("b")))


@query(_SCORES)
def token_sort_pairs(spark, sf_dir):
    """Scores of the part names' pairs with one first letter: a small vocabulary, whatever the size of the table."""
    register(spark)
    return spark.sql("SELECT a, b, round(token_sort_ratio(a, b), 6) AS score FROM {pairs}", pairs=_name_pairs(spark, sf_dir))


@query(_SCORES)
def token_sort_native(spark, sf_dir):
    """The same scores by higher-order functions."""
    return _name_pairs(spark, sf_dir).select("a", "b", F.round(token_sort_ratio_native(F.col("a"), F.col("b")), 6).alias("score"))


@query(f"WITH {o.NORMALISED} SELECT count(*) AS facts, count(*) FILTER (WHERE value_kind = 'number') AS numeric, count(value_num) AS parsed, count(period_start) AS with_period, count(as_of_date) AS with_as_of, count(entity_id) AS with_entity, count(*) FILTER (WHERE len(scope_tags) > 0) AS with_scope FROM nf")
def coverage_stats(spark, sf_dir):
    return res.coverage(normalised(spark, sf_dir))


@query(f"WITH {o.FACT_CTE}, fc AS (SELECT entity_id, count(*) AS n FROM facts GROUP BY 1) SELECT 'p' || p_partkey AS entity_id, p_name AS canonical_name, coalesce(n, 0) AS n_facts FROM part LEFT JOIN fc ON entity_id = 'p' || p_partkey ORDER BY n_facts DESC, entity_id LIMIT 10")
def top_entities(spark, sf_dir):
    named = adapters.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("entity_id"), F.col("p_name").alias("canonical_name"))
    return res.top_entities(named, facts(spark, sf_dir))


@query(f"WITH {o.FACT_CTE} SELECT fact_id, confidence FROM facts WHERE grounded AND doc_id = 'doc_1' AND (subject_raw ILIKE '%part 1%' OR attribute_raw ILIKE '%part 1%' OR value_raw ILIKE '%part 1%' OR scope_raw ILIKE '%part 1%') ORDER BY confidence DESC NULLS LAST, fact_id LIMIT 50")
def search_facts(spark, sf_dir):
    return reads.search_facts(facts(spark, sf_dir), text="part 1", doc_id="doc_1").select("fact_id", "confidence")


@query(f"WITH {o.VERDICTS} SELECT relation_id, verdict FROM rl WHERE verdict IN ('contradicts', 'superseded') AND a.doc_id <> b.doc_id AND (a.attribute_raw ILIKE '%revenue%' OR b.attribute_raw ILIKE '%revenue%') ORDER BY relation_id LIMIT 50")
def search_relations(spark, sf_dir):
    return reads.search_relations(relations(spark, sf_dir).withColumn("explanation", F.lit("")), ["contradicts", "superseded"], True, "revenue").select("relation_id", "verdict")


_TRUST = "(a.confidence + b.confidence) DESC NULLS FIRST"


@query(f"""WITH {o.WHOLE}, ac AS (SELECT * FROM rl WHERE verdict = 'corroborates' AND a.doc_id <> b.doc_id),
c1 AS (SELECT relation_id, fact_a, fact_b, row_number() OVER (ORDER BY {_TRUST}, abs(length(a.attribute_raw) - length(b.attribute_raw)) DESC, relation_id) AS r FROM ac WHERE lower(a.attribute_raw) <> lower(b.attribute_raw)),
c0 AS (SELECT relation_id, fact_a, fact_b, row_number() OVER (ORDER BY {_TRUST}, relation_id) AS r FROM ac)
SELECT relation_id, fact_a, fact_b FROM c1 WHERE r <= 3 UNION ALL SELECT relation_id, fact_a, fact_b FROM c0 WHERE r <= 3 AND NOT EXISTS (SELECT 1 FROM c1)""")
def case_1_corroborated(spark, sf_dir):
    return reads.case_corroborated(relations(spark, sf_dir, cap=None, named=("R8", "R10"))).select("relation_id", "fact_a", "fact_b")


@query(f"""WITH {o.WHOLE}, tr AS (SELECT * FROM rl WHERE verdict = 'contradicts' AND a.confidence >= 0.75 AND b.confidence >= 0.75 AND a.value_in_evidence AND b.value_in_evidence),
c2 AS (SELECT relation_id, row_number() OVER (ORDER BY a.doc_id <> b.doc_id DESC, {_TRUST}, relation_id) AS r FROM tr WHERE coalesce(a.period_end, a.as_of_date) = coalesce(b.period_end, b.as_of_date) AND abs(a.value_num - b.value_num) / greatest(abs(a.value_num), abs(b.value_num), 1) BETWEEN 0.01 AND 0.5),
c3 AS (SELECT relation_id, row_number() OVER (ORDER BY {_TRUST}, relation_id) AS r FROM tr)
SELECT relation_id FROM c2 WHERE r <= 3 UNION ALL SELECT relation_id FROM c3 WHERE r <= 3 AND NOT EXISTS (SELECT 1 FROM c2)""")
def case_2_contradicted(spark, sf_dir):
    return reads.case_contradicted(relations(spark, sf_dir, cap=None, named=("R14", "R15"))).select("relation_id")


@query(f"WITH {o.WHOLE} SELECT relation_id, bridging_fact_id FROM rl WHERE method = 'derivation' ORDER BY abs(a.value_num - b.value_num) DESC, relation_id LIMIT 3")
def case_3a_derived(spark, sf_dir):
    return reads.case_derived(relations(spark, sf_dir, cap=None, named=())).select("relation_id", "bridging_fact_id")


@query(f"WITH {o.VERDICTS}, sc AS MATERIALIZED (SELECT relation_id, a, b, a.doc_id <> b.doc_id AS x FROM rl WHERE verdict = 'reconciled' AND method = 'rule' AND a.scope_raw IS NOT NULL AND b.scope_raw IS NOT NULL) SELECT relation_id FROM sc WHERE x = (SELECT max(x) FROM sc) ORDER BY {_TRUST}, relation_id LIMIT 3")
def case_3b_scoped(spark, sf_dir):
    return reads.case_scoped(relations(spark, sf_dir)).select("relation_id")


@query(f"WITH {o.VERDICTS} SELECT relation_id FROM rl WHERE verdict = 'superseded' ORDER BY b.as_of_date DESC NULLS FIRST, relation_id LIMIT 3")
def case_3c_superseded(spark, sf_dir):
    return reads.case_superseded(relations(spark, sf_dir)).select("relation_id")


@query(f"WITH {o.NORMALISED} SELECT count(*) AS facts, count(*) FILTER (WHERE grounded) AS grounded, count(*) FILTER (WHERE NOT grounded) AS rejected, count(*) FILTER (WHERE value_kind = 'number' AND value_num IS NULL) AS unparsed, count(*) FILTER (WHERE grounded AND NOT value_in_evidence) AS uncheckable FROM nf")
def case_4_own_failures(spark, sf_dir):
    return reads.case_own_failures(normalised(spark, sf_dir))


@query(f"WITH {o.NORMALISED}, q AS (SELECT count(*) AS n, count(*) FILTER (WHERE grounded) AS g, count(value_num) AS v, count(*) FILTER (WHERE period_start IS NOT NULL OR as_of_date IS NOT NULL) AS d FROM nf) SELECT n, g AS grounded, v AS numeric, d AS dated, round(g * 100.0 / n, 4) AS grounded_percent FROM q")
def fact_quality(spark, sf_dir):
    return reads.fact_quality(normalised(spark, sf_dir))


@query(f"WITH RECURSIVE {o.CHUNKS}, {o.FACT_CTE} SELECT d.doc_id, coalesce(p.n, 0) AS pages, coalesce(c.n, 0) AS chunks, coalesce(f.n, 0) AS facts, coalesce(f.g, 0) AS grounded FROM (SELECT 'doc_' || doc_id AS doc_id FROM documents) d LEFT JOIN (SELECT doc_id, count(*) AS n FROM pages_ GROUP BY 1) p USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM ch GROUP BY 1) c USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE grounded) AS g FROM facts GROUP BY 1) f USING (doc_id)")
def doc_progress(spark, sf_dir):
    pages = adapters.pages(spark, sf_dir)
    documents = adapters.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("doc_id"))
    return reads.document_progress(documents, pages, pas.chunks(pages), facts(spark, sf_dir))


@query(f"WITH RECURSIVE {o.CHUNKS} SELECT 'chunk' AS stage, why_skipped AS kind, count(*) AS n FROM ch WHERE why_skipped IS NOT NULL GROUP BY 2")
def failures_by_kind(spark, sf_dir):
    skipped = pas.chunks(adapters.pages(spark, sf_dir)).where("why_skipped IS NOT NULL").select(F.lit("chunk").alias("stage"), F.col("why_skipped").alias("kind"))
    return reads.failures_by_kind(skipped)


@query(f"WITH {o.FACT_CTE} SELECT entity_id, count(*) AS n_facts FROM facts GROUP BY 1 HAVING count(*) >= 30")
def entity_list(spark, sf_dir):
    named = adapters.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("entity_id"))
    return reads.entity_list(named, facts(spark, sf_dir), 30)


@query(f"WITH {o.PAGE_CTE} SELECT doc_id, page_no, sha256(raw_text) AS sha256 FROM pages_ WHERE doc_id ILIKE '%DOC_17%' AND page_no = 1")
def page_lookup(spark, sf_dir):
    return reads.page_lookup(adapters.pages(spark, sf_dir), "DOC_17", 1).select("doc_id", "page_no", F.sha2("raw_text", 256).alias("sha256"))


@query("WITH u AS (SELECT sha256(coalesce(text, '')) AS sha256, 'f' || doc_id || '.pdf' AS filename, doc_id FROM documents) SELECT sha256, min(filename) AS filename FROM u WHERE sha256 NOT IN (SELECT sha256 FROM u WHERE doc_id < 50) GROUP BY 1")
def dedupe_uploads(spark, sf_dir):
    docs = adapters.table(spark, sf_dir, "documents")
    uploads = docs.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"), "doc_id")
    return files.fresh_uploads(uploads, uploads.where("doc_id < 50"))


@query("WITH u AS (SELECT sha256(coalesce(text, '')) AS h, 'My File ' || doc_id || ' (v2).pdf' AS f FROM documents) SELECT f AS filename, 'doc_' || regexp_replace(substr(regexp_replace(lower(regexp_replace(f, '\\.[^.]*$', '')), '[^a-z0-9]+', '_', 'g'), 1, 48), '^_+|_+$', '', 'g') || '_' || substr(h, 1, 8) AS doc_id FROM u")
def document_ids(spark, sf_dir):
    name = F.concat(F.lit("My File "), F.col("doc_id").cast("string"), F.lit(" (v2).pdf"))
    return adapters.table(spark, sf_dir, "documents").select(name.alias("filename"), files.document_id(name, F.sha2(F.coalesce("text", F.lit("")), 256)).alias("doc_id"))


def _orders(spark, sf_dir):
    return adapters.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT o_orderkey, min((o_custkey, o_orderstatus))[1] AS o_custkey, min((o_custkey, o_orderstatus))[2] AS o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def append_skip_conflicts(spark, sf_dir):
    orders = _orders(spark, sf_dir)
    return tables.new_rows(orders, orders.where("o_orderstatus = 'F'"), ["o_orderkey"])


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_custkey, o_orderkey, 'X' FROM orders WHERE o_orderstatus = 'P'")
def replace_document(spark, sf_dir):
    orders = _orders(spark, sf_dir)
    fresh = orders.where("o_orderstatus = 'P'").withColumn("o_orderstatus", F.lit("X"))
    return tables.replaced(orders, fresh, "o_custkey").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, c_name FROM customer")
def batched_update(spark, sf_dir):
    customers = adapters.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_name")
    return tables.updated(customers, customers.where("c_acctbal < 0").select("c_custkey", F.lit(0.0).alias("c_acctbal")), "c_custkey")


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def fk_audit(spark, sf_dir):
    parents = adapters.table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").withColumnRenamed("o_orderkey", "l_orderkey")
    return tables.orphans(adapters.table(spark, sf_dir, "lineitem"), parents, ["l_orderkey"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_audit(spark, sf_dir):
    return tables.repeated_keys(adapters.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'part', count(*) FROM part")
def table_counts(spark, sf_dir):
    return tables.table_counts(spark, {n: f"{sf_dir}/{n}.parquet" for n in ("orders", "part")})
