"""Merkle manifest of a dataset: a tree of digests for each language, a tree over their roots, and a proof for every row.

A row's leaf is the digest of its fields. Leaves take their places by a range sort, whose parts are counted, so no task holds a
tree. Trees grow in rounds of LEVELS levels by combineByKey: a frontier holds partial parents, each with the digests of its
children by slot; the child that fills a parent (its arity follows from the tree's size) makes it a digest, which goes to the next
level's parent at once. Tasks combine what they hold and only unresolved frontiers are shuffled; the next round
starts from the ancestors. Proofs come down by the same rounds: a node's siblings and those of its ancestors are handed to
the children that a block of nodes has.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.llm.work import stored

#: Children of a full node.
ARITY = 2
#: Levels that a round climbs: a block has at most ARITY ** LEVELS nodes.
LEVELS = 8
NODES = "tree long, place long, size long, digest string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """A field of a leaf: `-` if null, else its bytes' count, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-"))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*(field(c) for c in (doc_id, source, lang, n_chars, text))), 256)


def above(size: int, levels: int = 1) -> int:
    """Nodes that `levels` levels further up hold the ancestors of `size` nodes."""
    return -(-size // ARITY**levels) if size else 0


# --- places ---------------------------------------------------------------


def placed(rows: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """rows with place (from 0) and size: their place in the order of their `by`, null being a value, and how many that has.

    The sort is by range over all of `by`, `order` and the row's own place in the input, so equal rows may lie in several tasks. What a part
    holds of a `by` is counted, and the counts give each part its start.
    """
    salted = rows.withColumn("_own", F.monotonically_increasing_id())
    keys = [by, *order, "_own"]
    dealt = stored(salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_own").withColumn("_at", F.monotonically_increasing_id()), f"{name}-sorted")
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33))
    counts = stored(dealt.groupBy(by, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")), f"{name}-counts")
    of = Window.partitionBy(by)
    starts = counts.select(F.col(by).alias("_by"), F.col("_part").alias("_its"), "_first", (F.sum("_n").over(of.orderBy("_part")) - F.col("_n")).alias("_start"), F.sum("_n").over(of).alias("size"))
    joined = dealt.join(stored(starts, f"{name}-starts"), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_its")))
    return joined.select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_start")).alias("place"), "size")


# --- up -------------------------------------------------------------------


def opened(size: int) -> list:
    """An empty frontier of a block of a tree with `size` nodes: that size, partial parents (their children's digests by slot), the ancestor that left the round."""
    return [size, {}, None]


def added(frontier: list, level: int, place: int, value: str) -> list:
    """The frontier with a node taken in. A parent whose children are all there becomes a node of its own level."""
    size, partial, _ = frontier
    size = above(size, level)
    while level < LEVELS and size > 1:
        parent = place // ARITY
        children = partial.setdefault((level + 1, parent), {})
        children[place % ARITY] = value
        if len(children) < min(ARITY, size - parent * ARITY):
            return frontier
        del partial[level + 1, parent]
        value = digest("".join(children[slot] for slot in sorted(children)))
        level, place, size = level + 1, parent, above(size)
    frontier[2] = value
    return frontier


def merged(frontier: list, other: list) -> list:
    """Two frontiers of one block as one: what was partial in both may be whole now."""
    frontier[2] = frontier[2] or other[2]
    for (level, parent), children in other[1].items():
        for slot, value in children.items():
            added(frontier, level - 1, parent * ARITY + slot, value)
    return frontier


def ancestors(nodes: DataFrame, name: str) -> DataFrame:
    """The nodes LEVELS levels above `nodes`, or the root of a tree that ends before."""
    spark, full = nodes.sparkSession, ARITY**LEVELS
    keyed = nodes.select("tree", "place", "size", "digest").rdd.map(lambda r: ((r[0], r[1] // full), (r[1], r[2], r[3])))
    take = lambda frontier, node: added(frontier, 0, node[0], node[2])
    made = keyed.combineByKey(lambda node: take(opened(node[1]), node), take, merged, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = made.map(lambda kv: (kv[0][0], kv[0][1], above(kv[1][0], LEVELS), kv[1][2]))
    return stored(spark.createDataFrame(rows, NODES), name)


def grown(leaves: DataFrame, name: str) -> list[DataFrame]:
    """Levels of all trees, LEVELS apart, from the leaves (tree, place, size, digest) to the roots (place 0, size 1)."""
    rounds, most = [leaves], leaves.agg(F.max("size").alias("most")).first().most or 0
    while most > 1:
        rounds.append(ancestors(rounds[-1], name))
        most = above(most, LEVELS)
    return rounds


# --- down -----------------------------------------------------------------


def siblings_in(values: list[str], first: int, size: int) -> list[list[str]]:
    """For each of a block's nodes (places from `first`, `size` of them on the level) the digests of its siblings, level by level up to the block's top."""
    out: list[list[str]] = [[] for _ in values]
    row, start, of = list(values), first, size
    for level in range(LEVELS):
        if of <= 1:
            break
        for i, found in enumerate(out):
            place = (first + i) // ARITY**level
            run = place // ARITY * ARITY
            found.extend(row[p - start] for p in range(run, min(run + ARITY, of)) if p != place)
        tops = range(start // ARITY, (start + len(row) - 1) // ARITY + 1)
        row = [digest("".join(row[p * ARITY - start : min((p + 1) * ARITY, of) - start])) for p in tops]
        start, of = start // ARITY, above(of)
    return out


def handed_down(nodes: DataFrame, tails: DataFrame, also: list[str] | None = None) -> DataFrame:
    """proof (array of digests, from the node's own siblings to the root's children) for each node, from the tails of the blocks' ancestors.

    nodes: tree, place, size, digest and the columns `also`; tails: tree, place, tail. Blocks have bounded size and one tail each.
    """
    also = also or []
    full = ARITY**LEVELS
    mine = nodes.select("tree", F.expr(f"place DIV {full}").alias("block"), "place", "size", "digest", *also)
    proofs = pa.list_(pa.string())

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("place")
        tail = right.column("tail")[0].as_py() if right.num_rows else []
        places = left.column("place").to_pylist()
        own = siblings_in(left.column("digest").to_pylist(), places[0], left.column("size")[0].as_py()) if places else []
        return left.drop_columns(["block"]).append_column("proof", pa.array([p + tail for p in own], proofs))

    kinds = {f.name: f.dataType.simpleString() for f in mine.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in mine.columns if c != "block") + ", proof array<string>"
    return mine.groupBy("tree", "block").cogroup(tails.select("tree", F.col("place").alias("block"), "tail").groupBy("tree", "block")).applyInArrow(run, schema)


def proven(rounds: list[DataFrame], tops: DataFrame, name: str, also: list[str] | None = None) -> DataFrame:
    """The leaves of `rounds` with their proofs, given the tails of the roots (tree, place, tail)."""
    tails = tops
    for nodes in reversed(rounds[1:-1]):
        tails = stored(handed_down(nodes, tails).select("tree", "place", F.col("proof").alias("tail")), name)
    if len(rounds) == 1:  # every tree is a leaf
        return rounds[0].join(tails.select("tree", F.col("tail").alias("proof")), "tree")
    return handed_down(rounds[0], tails, also)


# --- the manifest ---------------------------------------------------------


def folded(value: str, proof: list[str], steps: list[tuple[int, int]]) -> str:
    """The root that a leaf and its siblings give. steps: (place, size) in the leaf's tree, then in the tree of roots."""
    at = 0
    for place, size in steps:
        while size > 1:
            run = place // ARITY * ARITY
            others = min(ARITY, size - run) - 1
            own = proof[at : at + others]
            own.insert(place - run, value)
            value, at = digest("".join(own)), at + others
            place, size = place // ARITY, above(size)
    return value


def with_folds(rows: DataFrame) -> DataFrame:
    """rows with folded_root: `claimed` folded with the row's proof."""

    def run(batches):
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("claimed", "proof", "place", "size", "rank", "trees")]
            roots = [folded(c, p, [(i, n), (r, t)]) for c, p, i, n, r, t in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())], [*batch.schema.names, "folded_root"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, folded_root string")


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf and claimed, the leaf of the row as it is said to be: tampered ones have one character more in n_chars."""
    d = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    more = d["n_chars"].cast("decimal(20,0)") + 1
    tampered = F.crc32(d["doc_id"].cast("string").cast("binary")) % 7 == 0
    claimed = F.when(tampered & d["n_chars"].isNotNull(), leaf_digest(d["doc_id"], d["source"], d["lang"], more, d["text"]))
    return docs.select("doc_id", "lang", leaf_digest(**d).alias("leaf"), claimed.alias("claimed"))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf, subroot, root, place, size, rank, trees, proof, claimed of every document.

    place and size are the leaf's in its language's tree, rank and trees the language's in the tree of subroots; proof has the siblings'
    digests from the leaf up to the root; claimed is the leaf as tampering made it. Nulls count as values: a null language is the first, a null
    doc_id the first of its language; any null field makes a `-` in the leaf, an empty text `0:`. Rows that repeat a doc_id are leaves
    of their own, ordered by digest; equal rows are equal leaves side by side. A table of one row has its leaf as root and an empty
    proof. An empty table gives an empty result. Other columns are not part of a leaf.
    """
    own = stored(leaves(docs), "merkle-leaves")
    langs = stored(own.select("lang").distinct().withColumn("all", F.lit(0)), "merkle-langs")
    ranks = stored(placed(langs, "all", ["lang"], "merkle-langs").select(F.col("lang").alias("its"), F.col("place").alias("rank"), F.col("size").alias("trees")), "merkle-ranks")
    rows = placed(own, "lang", ["doc_id", "leaf"], "merkle").join(ranks, F.col("lang").eqNullSafe(F.col("its")))
    rows = stored(rows.select(F.col("rank").alias("tree"), "place", "size", F.col("leaf").alias("digest"), "doc_id", "lang", "claimed", "trees"), "merkle-places")
    rounds = grown(rows, "merkle-nodes")
    last = rounds[-1].select("tree", "digest")
    subroots = stored(last.join(ranks, last.tree == ranks.rank).select(F.lit(0).cast("long").alias("tree"), F.col("rank").alias("place"), F.col("trees").alias("size"), "digest"), "merkle-subroots")
    upper = grown(subroots, "merkle-upper")
    start = subroots.sparkSession.createDataFrame([(0, 0, [])], "tree long, place long, tail array<string>")
    tops = proven(upper, start, "merkle-upper-proofs")
    roots = upper[-1].select("tree", F.col("digest").alias("root"))  # one row
    tops = stored(tops.join(F.broadcast(roots), "tree").select(F.col("place").alias("tree"), F.lit(0).cast("long").alias("place"), F.col("proof").alias("tail"), F.col("digest").alias("subroot"), "root"), "merkle-tops")
    out = proven(rounds, tops.select("tree", "place", "tail"), "merkle-proofs", ["doc_id", "lang", "claimed", "trees"])
    said = out.join(tops.select("tree", "subroot", "root"), "tree")
    return said.select("doc_id", "lang", F.col("digest").alias("leaf"), "subroot", "root", "place", "size", F.col("tree").alias("rank"), "trees", "proof", F.coalesce("claimed", "digest").alias("claimed"))


def verified(made: DataFrame) -> DataFrame:
    """The manifest's rows with folded_root, the root that `claimed` and the proof give, and verified, whether that is the root."""
    return with_folds(made).withColumn("verified", F.col("folded_root") == F.col("root"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document; see manifest()."""
    proof = F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256")
    return verified(manifest(docs)).select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")
