"""Exact duplicates through a log-structured merge index.

Digests of normalised texts go into memtables, one per input partition, that are flushed as runs
sorted by digest with a Bloom filter on it. Compaction merges runs into a level that holds, per digest, the row that
stays and the size of its group. A level takes later runs in: a filter of their digests tells which of its entries can be
hit, the others are carried over as they are. Rows of larger groups are then compared byte by
byte with the text that stays; texts that differ in spite of equal digests form groups of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.work import passing, probed, stored, whole, without

SPACES = r"[\x20\x09-\x0D]+"
RUN = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": "1000000", "parquet.enable.dictionary#digest": "false"}
#: What a row is known by, best first: most code points, then smallest identifier (null last), then any fixed order.
PLACE = "struct(-size AS less, doc_id IS NULL AS unnamed, doc_id, h, row)"


def text_of(docs: DataFrame):
    return F.coalesce(docs.text, F.lit(""))


def normal_of(text):
    return F.regexp_replace(text, SPACES, "")


def flushed(docs: DataFrame) -> DataFrame:
    """Runs of (digest, size, doc_id, h, row), each sorted by digest and written with a filter on it.

    h is the hash of the original text, size its code points, row a number of its own; a null text counts as empty.
    """
    text = text_of(docs)
    digest = F.unhex(F.sha2(normal_of(text).cast("binary"), 256))
    rows = docs.select(digest.alias("digest"), F.length(text).alias("size"), "doc_id", F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"))
    return stored(rows.sortWithinPartitions("digest"), "index-runs", RUN)


def merged(entries: DataFrame) -> DataFrame:
    """Entries (digest, best, group_size) with one entry a digest."""
    return entries.groupBy("digest").agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))


def compacted(runs: DataFrame, level: DataFrame | None = None) -> DataFrame:
    """One sorted level of (digest, best, group_size) from runs and an older level; best is the row that stays."""
    fresh = merged(runs.select("digest", F.expr(PLACE).alias("best"), F.lit(1).cast("long").alias("group_size")))
    if level is not None:
        keyed, new = level.withColumn("key", F.xxhash64("digest")), runs.select(F.xxhash64("digest").alias("key"))
        fresh = probed(keyed, "key", new, "left_anti").drop("key").union(merged(fresh.union(passing(keyed, "key", new).drop("key"))))
    return stored(fresh.sortWithinPartitions("digest"), "index-level", RUN)


def verified(docs: DataFrame, runs: DataFrame, level: DataFrame) -> DataFrame:
    """digest, doc_id, h, normal of the rows of larger groups whose text isn't that of the row that stays."""
    large = stored(level.where("group_size > 1").select("digest", "best"), "index-large").withColumn("key", F.xxhash64("digest"))
    hits = passing(runs.withColumn("key", F.xxhash64("digest")), "key", large).join(large.drop("key"), "digest")
    hits = stored(hits.select("digest", F.col("doc_id").alias("id"), "h", (F.col("row") == F.col("best.row")).alias("stays")).distinct(), "index-hits")
    texts = passing(docs.select("doc_id", text_of(docs).alias("text"), F.xxhash64(text_of(docs)).alias("h")), "h", hits)
    met = texts.withColumnRenamed("h", "of").join(hits, (F.col("of") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("id")))
    held = stored(met.select("digest", "doc_id", "h", "stays", normal_of(F.col("text")).alias("normal")), "index-held")
    kept = stored(held.where("stays").groupBy("digest").agg(F.min("normal").alias("kept_text")), "index-kept-texts")
    return held.join(kept, "digest").where("normal <> kept_text").select("digest", "doc_id", "h", "normal")


def placed(docs: DataFrame) -> DataFrame:
    """digest, size, doc_id, h, row, best, group_size of every row of docs (doc_id, text)."""
    runs = flushed(docs.select("doc_id", "text"))
    level = compacted(runs)
    joined = runs.join(level, "digest")
    differing = stored(verified(docs.select("doc_id", "text"), runs, level).distinct(), "index-differing")
    if differing.isEmpty():
        return joined
    # Digests collided: the texts themselves are the keys of the rows that differ.
    apart = differing.select(F.col("digest").alias("d"), F.col("doc_id").alias("id"), F.col("h").alias("of"), "normal")
    on = (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("of"))
    own = stored(runs.join(apart, on).select(*runs.columns, "normal"), "index-own")
    apart = own.groupBy("digest", "normal").agg(F.min(F.expr(PLACE)).alias("best"), F.count(F.lit(1)).alias("group_size"))
    lost = own.groupBy("digest").agg(F.count(F.lit(1)).alias("lost"))
    rest = joined.join(own.select("row"), "row", "left_anti").join(lost, "digest", "left")
    rest = rest.withColumn("group_size", F.col("group_size") - F.coalesce("lost", F.lit(0)))
    return rest.select(*joined.columns).union(own.join(apart, ["digest", "normal"]).select(*joined.columns))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs (doc_id, text).

    Texts are equal if identical without white space; nulls and texts of white space are all empty.
    Of equal texts the one with the most code points stays, then the smallest doc_id; of rows that
    tie in both, which repeat or differ in white space only, one stays. A null doc_id yields to any other.
    An empty table gives an empty result.
    """
    return placed(docs).select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, all columns: the row that stays in groups().

    Of rows that repeat its doc_id and text one stays, whatever their other columns hold. Nulls and empty texts are one
    group. An empty table stays empty.
    """
    pair = lambda doc_id, h: F.xxhash64(doc_id, h)
    rows = placed(docs).groupBy(pair(F.col("doc_id"), F.col("h")).alias("pair")).agg(F.max(F.col("row") == F.col("best.row")).alias("kept"), F.count(F.lit(1)).alias("n"))
    rows = stored(rows.where("NOT kept OR n > 1"), "index-placed")
    left = without(docs, pair(docs.doc_id, F.xxhash64(text_of(docs))), rows, "pair")
    again = rows.where("kept")
    if again.isEmpty():
        return left
    packed = docs.select(whole(docs).alias("row"), pair(docs.doc_id, F.xxhash64(text_of(docs))).alias("pair"))
    return left.union(passing(packed, "pair", again).join(again.select("pair"), "pair").dropDuplicates(["pair"]).select("row.*"))
