"""What users ask of the tables: searches, cases, dashboards, lookups. All are DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEARCHED = ("subject_raw", "attribute_raw", "value_raw", "scope_raw")


def contains_ci(x: Column, text: str) -> Column:
    return F.coalesce(x.ilike(f"%{text}%"), F.lit(False))


def search_facts(facts: DataFrame, text: str | None = None, grounded_only: bool = True, doc_id: str | None = None, entity_id: str | None = None, limit: int = 50) -> DataFrame:
    """Facts under all conditions that are given, the most confident first."""
    keep = F.lit(True)
    if grounded_only:
        keep = keep & F.col("grounded")
    if doc_id is not None:
        keep = keep & (F.col("doc_id") == doc_id)
    if entity_id is not None:
        keep = keep & (F.col("entity_id") == entity_id)
    if text:
        found = F.lit(False)
        for c in SEARCHED:
            found = found | contains_ci(F.col(c), text)
        keep = keep & found
    return facts.where(keep).orderBy(F.col("confidence").desc_nulls_last(), "fact_id").limit(limit)


def search_relations(relations: DataFrame, verdicts: list[str], across_only: bool = False, text: str | None = None, limit: int = 50) -> DataFrame:
    """Relations (with both facts a and b) of the given verdicts."""
    keep = F.col("verdict").isin(*verdicts)
    if across_only:
        keep = keep & (F.col("a.doc_id") != F.col("b.doc_id"))
    if text:
        keep = keep & (contains_ci(F.col("a.attribute_raw"), text) | contains_ci(F.col("b.attribute_raw"), text) | contains_ci(F.col("explanation"), text))
    return relations.where(keep).orderBy("relation_id").limit(limit)


TRUST = "a.confidence + b.confidence"


def better_class(rows: DataFrame, preferred: Column, then: Column | None, k: int, before: bool = False) -> DataFrame:
    """The k most trusted preferred rows, or the k most trusted of all others if none is preferred.

    then: what orders preferred rows besides trust, before or after it. One pass: k of either kind are ranked, then a kind is chosen.
    """
    trust = F.expr(TRUST).desc_nulls_first()
    kinds = rows.withColumn("_kind", F.when(F.coalesce(preferred, F.lit(False)), 0).otherwise(1))
    extra = [F.when(F.col("_kind") == 0, then).asc_nulls_last() if before else F.when(F.col("_kind") == 0, then).desc_nulls_first()] if then is not None else []
    order = [*extra, trust, "relation_id"] if before else [trust, *extra, "relation_id"]
    top = kinds.withColumn("_rank", F.row_number().over(Window.partitionBy("_kind").orderBy(*order))).where(F.col("_rank") <= k)
    return top.withColumn("_best", F.min("_kind").over(Window.partitionBy())).where("_kind = _best").orderBy("_rank").select(*rows.columns)


def case_corroborated(relations: DataFrame, k: int = 3) -> DataFrame:
    """Agreement across documents in other words; without any, agreement across documents."""
    across = relations.where("verdict = 'corroborates' AND a.doc_id <> b.doc_id")
    near = F.abs(F.length("a.attribute_raw") - F.length("b.attribute_raw"))
    return better_class(across, F.expr("lower(a.attribute_raw) <> lower(b.attribute_raw)"), near, k)


def case_contradicted(relations: DataFrame, k: int = 3) -> DataFrame:
    """Trusted, checkable facts of one moment that differ by 1 to 50 per cent, across documents first; without any, trusted contradictions."""
    trusted = relations.where("verdict = 'contradicts' AND a.confidence >= 0.75 AND b.confidence >= 0.75 AND a.value_in_evidence AND b.value_in_evidence")
    moment = "coalesce(a.period_end, a.as_of_date) = coalesce(b.period_end, b.as_of_date)"
    off = "abs(a.value_num - b.value_num) / greatest(abs(a.value_num), abs(b.value_num), 1D) BETWEEN 0.01 AND 0.5"
    return better_class(trusted, F.expr(f"{moment} AND {off}"), F.expr("CAST(a.doc_id = b.doc_id AS INT)"), k, before=True)


def case_derived(relations: DataFrame, k: int = 3) -> DataFrame:
    """Gaps that a third fact explains, the largest first."""
    return relations.where("method = 'derivation'").orderBy(F.expr("abs(a.value_num - b.value_num)").desc_nulls_first(), "relation_id").limit(k)


def case_scoped(relations: DataFrame, k: int = 3) -> DataFrame:
    """Differences explained by scope, across documents; without any, within."""
    scoped = relations.where("verdict = 'reconciled' AND method = 'rule' AND a.scope_raw IS NOT NULL AND b.scope_raw IS NOT NULL")
    return better_class(scoped, F.expr("a.doc_id <> b.doc_id"), None, k)


def case_superseded(relations: DataFrame, k: int = 3) -> DataFrame:
    """States that changed, the latest first; undated ones sort before all, as in the database."""
    return relations.where("verdict = 'superseded'").orderBy(F.col("b.as_of_date").desc_nulls_first(), "relation_id").limit(k)


def case_own_failures(facts: DataFrame) -> DataFrame:
    """One row: facts, grounded, rejected, numbers that don't parse, values missing from their own evidence."""
    return facts.agg(
        F.count(F.lit(1)).alias("facts"), F.count_if("grounded").alias("grounded"), F.count_if(~F.col("grounded")).alias("rejected"),
        F.count_if((F.col("value_kind") == "number") & F.col("value_num").isNull()).alias("unparsed"), F.count_if(F.col("grounded") & ~F.col("value_in_evidence")).alias("uncheckable"),
    )


def document_progress(documents: DataFrame, pages: DataFrame, chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """Per document: pages, passages, facts, grounded facts; zero where there are none."""
    n = lambda df, name: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    counted = documents.select("doc_id").join(n(pages, "pages"), "doc_id", "left").join(n(chunks, "chunks"), "doc_id", "left").join(n(facts, "facts"), "doc_id", "left").join(n(facts.where("grounded"), "grounded"), "doc_id", "left")
    return counted.na.fill(0)


def fact_quality(facts: DataFrame) -> DataFrame:
    """One row of counts and shares of grounded facts."""
    q = facts.agg(F.count(F.lit(1)).alias("n"), F.count_if("grounded").alias("grounded"), F.count_if(F.col("value_num").isNotNull()).alias("numeric"), F.count_if(F.col("period_start").isNotNull() | F.col("as_of_date").isNotNull()).alias("dated"))
    return q.withColumn("grounded_percent", F.round(F.try_divide(F.col("grounded") * 100.0, F.col("n")), 4))


def failures_by_kind(failures: DataFrame) -> DataFrame:
    return failures.groupBy("stage", "kind").agg(F.count(F.lit(1)).alias("n"))


def entity_list(entities: DataFrame, facts: DataFrame, least: int = 1) -> DataFrame:
    """Entities with at least `least` facts."""
    counted = facts.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_facts")).where(F.col("n_facts") >= least)
    return entities.select("entity_id").join(counted, "entity_id")


def page_lookup(pages: DataFrame, document: str, page_no: int) -> DataFrame:
    """The page of the documents whose identifier holds the text."""
    return pages.where(contains_ci(F.col("doc_id"), document) & (F.col("page_no") == page_no))


def stored_page(documents: DataFrame, pages: DataFrame, search: str, page_no: int) -> DataFrame:
    """doc_id, filename, page_no, raw_text, footnotes of the one document whose name or identifier holds the text; if several do, all of them without a page, to choose from."""
    found = documents.where(contains_ci(F.col("doc_id"), search) | contains_ci(F.col("filename"), search)).select("doc_id", "filename").limit(100)
    one = found.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    page = pages.where(F.col("page_no") == page_no).select("doc_id", "page_no", "raw_text", "footnotes")
    joined = one.join(page, (one.doc_id == page.doc_id) & (one.n == 1), "left")
    return joined.select(one.doc_id, "filename", "page_no", "raw_text", "footnotes")


def evidence_window(facts: DataFrame, pages: DataFrame, around: int = 500) -> DataFrame:
    """fact_id, before, quote, after: the evidence's surroundings on its page."""
    c = F.col
    joined = facts.where("char_start IS NOT NULL").join(pages.select("doc_id", "page_no", "raw_text"), ["doc_id", "page_no"])
    start = F.greatest(c("char_start") - around, F.lit(0))
    cut = lambda a, b: F.substring("raw_text", a + 1, b - a)
    return joined.select("fact_id", cut(start, c("char_start")).alias("before"), cut(c("char_start"), c("char_end")).alias("quote"), cut(c("char_end"), c("char_end") + around).alias("after"))
