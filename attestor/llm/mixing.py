"""Mixing sources to target weights by repetition rates.

Tokens are summed per source, targets are filled up by weight below a cap, and each document is
taken floor(rate) times plus one more with probability equal to the rate's fraction, decided by a
hash of its identifier and its source's seed. Of SEEDS seeds a source uses the one whose total
comes nearest to its target; all of them are summed up in the same pass as each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.llm.work import stored, whole

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SEEDS = 16
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """docs with size: the number of words of a text; none in a null text."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def targets(sources: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target, rate of sources (source, source_size).

    Sources in code point order, null last, take turns with the weights. They share `share` times the
    sum of all sizes by weight; a target stops at `cap` times its source's size and the excess is
    shared anew until no target is above. Only sums reach the driver.
    """
    ranges = sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    placed = stored(ranges.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33)), "mixing-sources")
    before = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("before"))
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("before") + F.col("at"), F.lit(len(weights))) + 1).cast("int"))
    weighed = stored(placed.join(F.broadcast(before), "part").select("source", "source_size", turn.alias("weight"), (F.col("source_size") * cap).alias("most")), "mixing-weights")
    total = (weighed.agg(F.sum("source_size").alias("s")).first().s or 0) * share
    level = None
    while True:
        full = F.lit(False) if level is None else F.col("most") <= F.col("weight") * level
        got = weighed.agg(F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)).alias("filled"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open")).first()
        new = (total - got.filled) / got.open if got.open else level
        if new is None or (level is not None and new <= level):
            level = new if level is None else level
            break
        level = new
    target = F.least("most", F.col("weight") * F.lit(float(level or 0.0)))
    return weighed.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def uniform(seed) -> F.col:
    """A number in [0, 1) from the MD5 of a document's identifier and a seed."""
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), seed).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def planned(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), doc_id, source, source_size, target, rate and copies (how often the mix takes the row).

    A null text has size 0, a null source is a source of its own; rows of size 0 are taken like
    others of their source, adding nothing. Rows with equal doc_id in a source are taken equally
    often. No row is taken more than ceil(cap) times. Reruns agree: no draw depends on the order of rows.
    """
    rows = stored(sized(docs.select("doc_id", "source", "text")).select("doc_id", "source", "size"), "mixing-sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rates = stored(targets(sources), "mixing-rates")
    fraction = F.col("rate") - F.floor("rate")
    rated = rows.join(F.broadcast(rates) if rates.limit(10_001).count() <= 10_000 else rates, rows.source.eqNullSafe(rates.source)).select("doc_id", rows.source.alias("source"), "size", "target", "rate")
    sums = [F.sum(F.col("size") * (F.floor("rate") + (uniform(F.lit(str(i))) < fraction).cast("int"))).alias(f"s{i}") for i in range(SEEDS)]
    drawn = rated.groupBy("source").agg(F.first("target").alias("target"), *sums)
    off = F.array(*(F.struct(F.abs(F.col(f"s{i}") - F.col("target")).alias("off"), F.lit(i).alias("seed")) for i in range(SEEDS)))
    seeds = drawn.select("source", F.array_min(off)["seed"].cast("string").alias("seed"))
    plan = stored(rates.join(seeds, rates.source.eqNullSafe(seeds.source)).select(rates.source.alias("key"), "source_size", "target", "rate", "seed"), "mixing-plan")
    few = plan.limit(10_001).count() <= 10_000
    packed = docs.select(whole(docs).alias("row"), "doc_id", "source")
    named = packed.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("key")))
    return named.withColumn("copies", (F.floor("rate") + (uniform(F.col("seed")) < fraction).cast("int")).cast("long")).drop("key", "seed")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    size = F.coalesce(F.regexp_count("row.text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = planned(docs.select("doc_id", "source", "text")).withColumn("size", size)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it is taken, with the columns of docs.

    Nulls, empty texts, repeated rows and ties are as in planned(). An empty table stays empty.
    """
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return planned(docs).where("copies > 0").select("row", again.alias("copy")).select("row.*")
