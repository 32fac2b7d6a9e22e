"""SimHash near-duplicates with a pivot distance table.

Texts become 64-bit fingerprints; distinct fingerprints that differ in at most RADIUS bits are
linked. Every fingerprint has a row of Hamming distances to PIVOTS fixed reference fingerprints;
by the triangle inequality a linked pair can't differ by more than RADIUS in any of them, so
pairs with a larger coordinate difference are discarded unseen and the rest are verified.

Pairs are looked for inside blocks: of the four 16-bit quarters of two fingerprints at most RADIUS
(2) differ, so two quarters agree in some pair of quarters, and six keys find every link. A block
of more than BLOCK fingerprints isn't paired. Its members are linked exactly through the
fingerprints one bit away: two fingerprints are within two bits if and only if some fingerprint is
within one bit of both, and no such meeting point has more than 65 members.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.llm.components import components
from attestor.llm.work import passing, pieces, small_batches, stored, without

PIVOTS = 16
RADIUS = 2
BLOCK = 48
SHINGLE = 3
SEED = 42
#: Of the stage: bits that pairs of the least similarity may differ in in a block, keys of blocks.
STAGE_RADIUS = 20
BANDS, ROWS = 8, 3
JURY = 32
MULTIPLIERS = np.array([xxhash.xxh64_intdigest(b"minimum %d" % i, SEED) | 1 for i in range(BANDS * ROWS)], np.uint64)
#: Of the table that orders shingles.
BUCKETS = 1 << 18
COUNT_BITS = 44
BUCKET_MULTIPLIER = np.uint64(xxhash.xxh64_intdigest(b"bucket", SEED) | 1)
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def hashes_of(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hashes of the word shingles of a text, A-Z lower-cased; of all words at once if there are fewer; empty without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, "<u8")
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], "<u8")
    grams = map(b" ".join, zip(*(islice(words, i, None) for i in range(shingle)), strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), "<u8", len(words) - shingle + 1)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Unsigned fingerprint: bit set if in over half of the hashes; zero without any."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[i : i + CHUNK].view(np.uint8), bitorder="little").reshape(-1, 64)
        full = len(bits) // 255 * 255
        if full:
            ones += bits[:full].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        if full < len(bits):
            ones += bits[full:].sum(0, dtype=np.uint8)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row; a null text counts as empty."""

    def run(batches):
        for batch in pieces(batches):
            fps = np.array([fingerprint_of(hashes_of(t, shingle, seed)) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def pivot(i: int) -> int:
    """Reference fingerprint i: fixed, from a hash of its number."""
    return int(np.uint64(xxhash.xxh64_intdigest(b"pivot %d" % i, SEED)).view(np.int64))


def pivot_distances() -> list:
    """The columns of the pivot distance table for a column fp."""
    return [F.bit_count(F.col("fp").bitwiseXOR(F.lit(pivot(i)))).cast("byte").alias(f"p{i}") for i in range(PIVOTS)]


def within(radius: int):
    """No coordinate of rows a and b differs by more than the radius, and then neither do their fingerprints."""
    on = F.abs(F.col("a.p0") - F.col("b.p0")) <= radius
    for i in range(1, PIVOTS):
        on &= F.abs(F.col(f"a.p{i}") - F.col(f"b.p{i}")) <= radius
    return on & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius)


def linked(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct fingerprints (fp) within RADIUS bits, directly or through shared neighbours' stars."""
    table = distinct.select("fp", *pivot_distances())
    quarter = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keys = F.array(*(F.lit(n).cast("long") * (1 << 32) + quarter[i] * 65536 + quarter[j] for n, (i, j) in enumerate((i, j) for i in range(4) for j in range(i))))
    keyed = table.withColumn("block", F.explode(keys))
    sizes = stored(keyed.groupBy("block").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "simhash-sizes")
    blocked = stored(keyed.join(sizes, "block"), "simhash-blocks")
    a, b = (blocked.where(F.col("size") <= BLOCK).alias(x) for x in "ab")
    pairs = a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.fp") < F.col("b.fp")) & within(RADIUS)).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    crowd = blocked.where(F.col("size") > BLOCK).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(int(np.uint64(1 << i).view(np.int64))) for i in range(64)))
    meeting = crowd.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
    stars = meeting.groupBy("at").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, fingerprint (16 lower-case hex digits), component_id of every row of docs (doc_id, text).

    component_id is the smallest doc_id among the rows reachable over links of at most RADIUS bits,
    the row's own included. Null and empty texts have fingerprint zero and link like any other;
    repeated rows share a fingerprint. A null doc_id never becomes a component_id unless all are
    null. An empty table gives an empty result. Only fingerprints, not copies, are paired.
    """
    fps = stored(fingerprints(docs, shingle), "simhash-fingerprints")
    first = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(linked(first), "simhash-components")
    rooted = stored(first.join(roots, first.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
    lowest = stored(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-lowest")
    classes = stored(rooted.select("fp", "root").join(lowest, "root").select("fp", "component_id"), "simhash-classes")
    return fps.join(classes, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keys_of(shingles: np.ndarray) -> list[int]:
    """Keys of BANDS bands of ROWS minima each."""
    minima = [int((shingles * m ^ (shingles * m >> np.uint64(29))).min()) for m in MULTIPLIERS]
    keys = [xxhash.xxh64_intdigest(repr((b, minima[b * ROWS : b * ROWS + ROWS])).encode(), SEED) for b in range(BANDS)]
    return [int(k) for k in np.array(keys, np.uint64).view(np.int64)]


def similar(a: str, b: str, least: Fraction):
    """Whether two columns of distinct shingle hashes have a Jaccard similarity of at least `least`, in whole numbers."""
    both = F.size(F.array_intersect(a, b))
    return both * least.denominator >= (F.size(a) + F.size(b) - both) * least.numerator


def keyed(docs: DataFrame, shingle: int) -> DataFrame:
    """node, doc_id, fp, keys, same (a hash of the set of shingles) of every row with words. docs: node, doc_id, text.

    Rows with a null `same` hold how many shingles a task found in buckets of hashes, in keys: bucket and number in one long.
    """

    def run(batches):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["node", "doc_id", "fp", "same", "keys"])
        crowd = np.zeros(BUCKETS, np.int64)
        for batch in pieces(batches):
            rows = []
            for node, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("node", "doc_id", "text")), strict=True):
                if len(h := hashes_of(text, shingle)):
                    same = xxhash.xxh64_intdigest((u := np.unique(h)).tobytes(), SEED)
                    rows.append((node, doc_id, *np.array([fingerprint_of(h), same], np.uint64).view(np.int64).tolist(), keys_of(u)))
                    np.add.at(crowd, bucketed(u), 1)
            yield made(rows)
        if len(at := np.flatnonzero(crowd)):
            yield made([(None, None, None, None, (at << COUNT_BITS) + crowd[at])])

    return docs.select("node", "doc_id", "text").mapInArrow(run, "node long, doc_id long, fp long, same long, keys array<long>")


def sets_of(texts: DataFrame, shingle: int) -> DataFrame:
    """node, shingles (distinct hashes) of every row with words. Made anew where needed: stored for all, they would be larger than the texts."""

    def run(batches):
        for batch in pieces(batches, 64):
            sets = [np.unique(hashes_of(t, shingle)).view(np.int64) for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            made = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), made], ["node", "shingles"]).filter(pa.array(np.diff(ends) > 0))

    return texts.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def node_of(docs: DataFrame):
    return F.xxhash64(docs.doc_id, docs.text)


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, least: Fraction) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have a Jaccard similarity of at least `least`. Only sets of nodes in pairs are moved."""
    nodes = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "simhash-paired")
    sets = stored(sets_of(passing(texts.select("node", "text"), "node", nodes), shingle).join(nodes, "node").groupBy("node").agg(F.first("shingles").alias("shingles")), "simhash-nodes")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    return both.where(similar("sa", "sb", least)).select("a", "b")


def crowding(keys: DataFrame) -> np.ndarray:
    """Shingles in each of BUCKETS buckets of hashes, from keyed(): a table of fixed size that puts shingles of many texts last."""
    counted = keys.where("same IS NULL").select(F.explode("keys").alias("x")).select(F.shiftright("x", COUNT_BITS).alias("bucket"), F.col("x").bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).alias("n"))
    found = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def bucketed(hashes: np.ndarray) -> np.ndarray:
    return (hashes * BUCKET_MULTIPLIER >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def prefix_of(shingles: np.ndarray, table: np.ndarray, least: Fraction) -> np.ndarray:
    """The first shingles of a set, rare buckets first; sets of a similarity of at least `least` have their first common shingle there."""
    n = len(shingles)
    order = np.lexsort((shingles, table[bucketed(shingles)]))
    return shingles[order[: n - -(-n * least.numerator // least.denominator) + 1]]


def prefixes(texts: DataFrame, shingle: int, least: Fraction, crowd: np.ndarray) -> DataFrame:
    """token, node, size (of the set), at (place in the order), end (number by which the prefix's last shingle is ordered) of all shingles of the prefixes."""
    shared = texts.sparkSession.sparkContext.broadcast(crowd)

    def run(batches):
        for part in pieces(batches, 64):
            members = [np.unique(hashes_of(t, shingle)) for t in part.column("text").to_pylist()]
            firsts = [prefix_of(x, shared.value, least) if len(x) else x for x in members]
            n = [len(x) for x in firsts]
            ends = [int(shared.value[bucketed(x[-1:])][0]) if len(x) else 0 for x in firsts]
            columns = np.concatenate(firsts).view(np.int64), np.repeat(part.column("node").to_numpy(), n), np.repeat([len(x) for x in members], n), np.concatenate([np.arange(k) for k in n]), np.repeat(ends, n)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["token", "node", "size", "at", "end"])

    return texts.select("node", "text").mapInArrow(run, "token long, node long, size long, at long, end long")


def pairs_apart(texts: DataFrame, shingle: int, roots: DataFrame, least: Fraction, crowd: np.ndarray) -> DataFrame:
    """All pairs (a, b) of nodes under different roots that can have a similarity of at least `least`, and some that don't.

    Exact, as two sets of sizes m and n with such a similarity s have at least s / (1 + s) (m + n) common shingles. The first of them is in
    both prefixes, and from it on both sets must have that many left. Of the two, take the one whose prefix ends earlier in the order: a shingle
    of its prefix that the other has stands in the other's prefix too, so shingles of its prefix that no other root's prefix holds aren't common and don't count.
    The more rare shingles a set has for itself, the fewer pairs it makes. Shingles of one root only are left out before anything is paired.
    """
    first = stored(prefixes(texts, shingle, least, crowd), "simhash-prefixes")
    ends = lambda c: (F.min(c).alias("lo"), F.max(c).alias("hi"))
    shared = stored(first.groupBy("token").agg(*ends("node")).where("lo <> hi").select("token"), "simhash-tokens")
    meeting = passing(first, "token", shared).join(shared, "token")
    rooted = stored(meeting.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "simhash-rooted")
    counts = rooted.groupBy("token", "root").agg(F.count(F.lit(1)).alias("n"))
    between = counts.groupBy("token").agg(F.max_by("root", F.struct("n", "root")).alias("major"), *ends("root")).where("lo <> hi").select("token", "major")
    p, q = least.numerator, least.denominator
    after = F.floor((F.col("size") * p + q - 1) / q) - 1
    of_node = Window.partitionBy("node")
    apart = rooted.join(stored(between, "simhash-between"), "token").distinct()
    rest = F.count(F.lit(1)).over(of_node.orderBy(F.desc("at"), "token").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + after
    apart = stored(apart.select("token", "node", "root", "major", "size", "end", (F.col("size") - F.col("at")).alias("all"), rest.alias("rest")), "simhash-apart")
    enough = lambda common, m, n: common * (p + q) >= (F.col(m) + F.col(n)) * p
    left = [F.when(F.col(f"{x}.end") < F.col(f"{y}.end"), F.col(f"{x}.rest")).otherwise(F.col(f"{x}.all")) for x, y in ("ab", "ba")]
    # Nodes of a token's largest root are met by the others only, so a large group that shares a few shingles is never paired with itself.
    other = (F.col("b.root") == F.col("b.major")) | (F.col("a.node") < F.col("b.node"))
    on = (F.col("a.token") == F.col("b.token")) & (F.col("a.root") != F.col("b.root")) & other & enough(F.least(*left), "a.size", "b.size")
    met = apart.where("root <> major").alias("a").join(apart.alias("b"), on)
    return stored(met.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct(), "simhash-apart-pairs")


def similar_pairs(rows: DataFrame, texts: DataFrame, shingle: int, least: Fraction, crowd: np.ndarray) -> DataFrame:
    """Links (a, b) that connect exactly the nodes with a similarity of at least `least`, directly or through others.

    Most are found first, so that groups of copies are one root before anything is paired: equal sets are compared with the
    first of them, and in a block each node with two leaders, the middle one of
    JURY members that hashes pick and the first of them, unless the pivot table discards the pair. That only
    saves work: whatever it leaves apart is paired by pairs_apart.
    """
    thin = rows.select("node", "fp", F.explode("keys").alias("block"))
    shared = stored(thin.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("block"), "simhash-shared")
    thin = stored(passing(thin, "block", shared).join(shared, "block"), "simhash-blocks")
    few = thin.withColumn("r", F.row_number().over(Window.partitionBy("block").orderBy(F.xxhash64("node"), "node"))).where(F.col("r") <= JURY)
    jury = few.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("r", "node", "fp"))).alias("j"))
    far = lambda x: F.aggregate("j", F.lit(0), lambda s, y: s + F.bit_count(x["fp"].bitwiseXOR(y["fp"])))
    middle = F.array_min(F.transform("j", lambda x: F.struct(far(x).alias("far"), x["node"].alias("node"), x["fp"].alias("fp"))))
    first = F.get("j", F.lit(0))
    both = F.array_distinct(F.array(F.struct(middle["node"].alias("node"), middle["fp"].alias("fp")), F.struct(first["node"].alias("node"), first["fp"].alias("fp"))))
    leaders = stored(jury.select("block", F.explode(both).alias("l")).select("block", "l.*").select("block", "node", "fp", *pivot_distances()), "simhash-leaders")
    on = (F.col("a.block") == F.col("b.block")) & (F.col("a.node") != F.col("b.node")) & within(STAGE_RADIUS)
    stars = thin.select("block", "node", "fp", *pivot_distances()).alias("a").join(leaders.alias("b"), on).select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"))
    firsts = stored(rows.groupBy("same").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a <> last").select("same", "a"), "simhash-firsts")
    equal = rows.select("node", "same").join(firsts, "same").where("node <> a").select("a", F.col("node").alias("b"))
    found = stored(stars.union(equal).distinct(), "simhash-pairs")
    links = stored(verified(found, texts, shingle, least), "simhash-links")
    apart = pairs_apart(texts, shingle, stored(components(links, "simhash-components"), "simhash-linked"), least, crowd)
    return links.union(verified(apart, texts, shingle, least))


def kept_of_near_duplicates(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id; all columns of docs.

    Near duplicates at a similarity of 0.8 are up to STAGE_RADIUS bits apart, too many for keys of exact
    bits. Blocks come from minima of the shingles' hashes instead, and a prefix filter on rare shingles finds every pair
    that they miss; the sets of shingles are compared: their Jaccard similarity, exact but for equal 64-bit hashes, is at least `least`. Groups are
    the components of such links. Texts without words are never near duplicates. Rows that repeat
    doc_id and text stay or go together; a null doc_id yields to any other.
    """
    texts = docs.select(node_of(docs).alias("node"), "doc_id", "text")
    small_batches(docs.sparkSession)
    keys = stored(keyed(texts, shingle), "simhash-keys")
    rows = keys.where("same IS NOT NULL")
    roots = stored(components(similar_pairs(rows, texts, shingle, Fraction(str(least)), crowding(keys)), "simhash-components"), "simhash-roots")
    named = rows.select("node", "doc_id").distinct().join(roots, "node")
    stay = stored(named.groupBy("root").agg(F.min_by("node", F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("stay")), "simhash-stay")
    gone = stored(roots.join(stay, "root").where("node <> stay").select("node").distinct(), "simhash-gone")
    return without(docs, node_of(docs), gone, "node")
