"""Candidate pairs: facts that share an entity and an attribute family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.sources.scratch import stored

BUCKET_CAP = 120
#: A bucket of more facts is cut into blocks of about as many, and each two blocks meet in a cell of their own.
BLOCK = 1000
KEYS = ["entity_id", "attribute_family"]
#: Equal in both facts of one statement written twice; the end of a period is not among them.
STATEMENT = ["doc_id", "page_no", "value_num", "value_text", "period_start", "as_of_date", "scope_raw"]


def comparable(facts: DataFrame) -> DataFrame:
    """Grounded facts with an entity, a family and a value."""
    return facts.where("grounded AND entity_id IS NOT NULL AND attribute_family IS NOT NULL AND (value_num IS NOT NULL OR value_text IS NOT NULL)")


def capped(facts: DataFrame, cap: int = BUCKET_CAP) -> DataFrame:
    """At most `cap` facts a bucket, the most confident first, then by fact_id: what bounds the pairs of a bucket."""
    order = Window.partitionBy(*KEYS).orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), "fact_id")
    return facts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap).drop("place")


def same_statement(a: str = "a", b: str = "b") -> Column:
    same = F.lit(True)
    for c in STATEMENT:
        same = same & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return same


def in_cells(facts: DataFrame, block: int) -> DataFrame:
    """Facts with `block`, and `low` and `high`, the two blocks of a cell: a fact is there once for each cell of its block.

    Any two facts of a bucket have exactly one cell of their own two blocks. Buckets of up to `block` facts have one block
    and one cell, so only large ones take more rows, and no group of (bucket, cell) has many more than twice `block`.
    """
    large = stored(facts.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block), "large")
    dealt = facts.join(large, KEYS, "left").withColumn("_n", F.coalesce(F.ceil(F.col("_n") / block), F.lit(1)).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("fact_id"), F.col("_n")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda other: F.struct(F.least("block", other).alias("low"), F.greatest("block", other).alias("high")))
    return dealt.withColumn("_cell", F.explode(cells)).select(*facts.columns, "block", "_cell.low", "_cell.high")


def pairs(facts: DataFrame, cap: int | None = BUCKET_CAP) -> DataFrame:
    """relation_id, fact_a, fact_b, and both facts as structs a and b; fact_a is the smaller. cap: None for all pairs of every bucket.

    Both sides of the join are one exchange by bucket; the facts travel with it, so that no later step
    has to look them up.
    """
    kept, on, own_cell = comparable(facts), KEYS, F.lit(True)
    names = [c for c in kept.columns if c not in KEYS]
    if cap is not None:
        kept = capped(kept, cap)
    if cap is None or cap > BLOCK:
        kept, on, names = in_cells(kept, BLOCK), [*KEYS, "low", "high"], [*names, "block"]
        own_cell = (F.least("a.block", "b.block") == F.col("low")) & (F.greatest("a.block", "b.block") == F.col("high"))
    packed = kept.select(*on, F.struct(*names).alias("f"))
    a, b = packed.withColumnRenamed("f", "a"), packed.withColumnRenamed("f", "b")
    joined = a.join(b, on).where((F.col("a.fact_id") < F.col("b.fact_id")) & own_cell & ~same_statement())
    relation = F.substring(F.concat(F.lit("rel_"), "a.fact_id", F.lit("__"), "b.fact_id"), 1, 200)
    return joined.select(relation.alias("relation_id"), F.col("a.fact_id").alias("fact_a"), F.col("b.fact_id").alias("fact_b"), *KEYS, "a", "b")


def candidates(facts: DataFrame, cap: int | None = BUCKET_CAP) -> DataFrame:
    """The relations table before any verdict."""
    null = F.lit(None).cast("string")
    return pairs(facts, cap).select("relation_id", "fact_a", "fact_b", F.lit("candidate").alias("verdict"), F.lit("blocking").alias("method"), null.alias("explanation"), null.alias("bridging_fact_id"))


def bucket_sizes(facts: DataFrame, cap: int = BUCKET_CAP) -> DataFrame:
    """Per bucket: facts, facts kept under the cap, and the pairs that those make."""
    n, kept = F.count(F.lit(1)), F.least(F.count(F.lit(1)), F.lit(cap))
    sized = comparable(facts).groupBy(*KEYS).agg(n.alias("n_facts"), kept.cast("long").alias("n_kept"))
    return sized.withColumn("n_pairs", (F.col("n_kept") * (F.col("n_kept") - 1) / 2).cast("long"))


def biggest_buckets(facts: DataFrame, k: int = 12) -> DataFrame:
    return bucket_sizes(facts).orderBy(F.desc("n_facts"), *KEYS).limit(k)


def pair_statistics(facts: DataFrame) -> DataFrame:
    """One row: pairs within and across documents, duplicate statements skipped, buckets that were capped, and what blocking saves."""
    found = pairs(facts).agg(F.count_if(F.col("a.doc_id") == F.col("b.doc_id")).alias("within_document"), F.count_if(F.col("a.doc_id") != F.col("b.doc_id")).alias("across_documents"))
    sizes = bucket_sizes(facts).agg(F.count_if(F.col("n_facts") > F.col("n_kept")).alias("capped_buckets"), F.sum("n_pairs").alias("all_pairs"), F.sum("n_facts").alias("facts"))
    sized = sizes.select(F.struct("capped_buckets", "all_pairs", "facts")).scalar()
    joined = found.withColumn("_s", sized).select("within_document", "across_documents", "_s.*")
    made = F.col("within_document") + F.col("across_documents")
    exhaustive = (F.col("facts") * (F.col("facts") - 1) / 2).cast("long")
    return joined.select("within_document", "across_documents", (F.col("all_pairs") - made).alias("duplicates_skipped"), "capped_buckets", exhaustive.alias("exhaustive_pairs"), F.round(F.try_divide(exhaustive.cast("double"), made.cast("double")), 4).alias("reduction"))
