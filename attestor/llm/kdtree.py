"""Exact top-k inner products with a k-d tree per shard.

Rows are dealt to shards of bounded size. Each shard is split at the median of its widest dimension
down to small leaves with tight bounding boxes, and is stored with its tree. Queries are dealt to blocks
of bounded size, which executors join to the shards; nothing of either passes through the driver. A query visits a shard's nodes best first by the
bound of a box, sum over dimensions of max(q * low, q * high), and stops when the next bound cannot beat the kth score so far.
Each block first searches one shard, and the kth scores found there are handed to the search of all the others.

Scores are exact integers: vectors whose inner products stay below 2^53 are worked on in floating point, those with a larger component
(`huge`) lie in shards and blocks of their own, without a tree, and are worked on in whole numbers of any length.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.llm.work import stored

SHARD_ROWS = 8192
LEAF_ROWS = 128
QUERY_BLOCK = 4096
SCALE = 256
#: Blocks of queries are broadcast up to this size, beyond it they are shuffled to the shards.
BROADCAST_BYTES = 64 << 20
#: Blocks whose kth scores a task carries from one shard to the next.
CARRIED = 64
LIMITS = (-(2**63), 2**63 - 1)


class Tree:
    """Median splits with tight boxes over vectors in `rows`, reordered so that rows of a leaf are contiguous.

    Nodes have low, high, the first of two children (-1 for a leaf) and a range of rows.
    """

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF_ROWS):
        self.order = np.arange(len(vectors))
        low, high, left, spans = [], [], [], []

        def node() -> int:
            for x, v in ((low, None), (high, None), (left, -1), (spans, (0, 0))):
                x.append(v)
            return len(low) - 1

        todo = [(0, len(vectors), node())] if len(vectors) else []
        while todo:
            start, end, at = todo.pop()
            rows = vectors[self.order[start:end]]
            low[at], high[at], spans[at] = rows.min(0), rows.max(0), (start, end)
            width = high[at] - low[at]
            if end - start <= leaf or not width.any():
                continue
            dim, mid = int(width.argmax()), (end - start) // 2
            self.order[start:end] = self.order[start:end][np.argpartition(rows[:, dim], mid)]
            left[at] = node()
            node()
            todo += [(start, start + mid, left[at]), (start + mid, end, left[at] + 1)]
        self.rows = vectors[self.order]
        self.low, self.high = (np.array(x, float).reshape(len(left), vectors.shape[1]) for x in (low, high))
        self.left, self.range = np.array(left, np.int64), np.array(spans, np.int64).reshape(len(left), 2)

    def packed(self) -> list[bytes]:
        return [x.tobytes() for x in (self.rows, self.low, self.high, self.left, self.range)]

    @staticmethod
    def unpacked(rows: bytes, low: bytes, high: bytes, left: bytes, spans: bytes, dims: int, n: int) -> Tree:
        tree = object.__new__(Tree)
        tree.left, tree.range = np.frombuffer(left, np.int64), np.frombuffer(spans, np.int64).reshape(-1, 2)
        tree.rows, tree.low, tree.high = (np.frombuffer(x, float).reshape(m, dims) for x, m in ((rows, n), (low, len(tree.left)), (high, len(tree.left))))
        return tree

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bound of the inner product of each query with any row below each node."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, bounds: np.ndarray, ids: np.ndarray, own: int, k: int, least: float) -> list[tuple[int, int]]:
        """The k best (score, -id) of the tree that reach `least`; ties at the kth score are kept apart by id. ids are in the tree's order."""
        best: list[tuple[int, int]] = []
        heap = [(-bounds[0], 0)] if len(bounds) else []
        while heap:
            bound, at = heapq.heappop(heap)
            if -bound < (max(least, best[0][0]) if len(best) == k else least):
                break
            if self.left[at] >= 0:
                for child in (int(self.left[at]), int(self.left[at]) + 1):
                    heapq.heappush(heap, (-bounds[child], child))
                continue
            start, end = self.range[at]
            scores = self.rows[start:end] @ query
            floor = max(least, best[0][0]) if len(best) == k else least
            for i in np.flatnonzero(scores >= floor).tolist():
                other = int(ids[start + i])
                if other == own:
                    continue
                item = (int(scores[i]), -other)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return best


def whole_numbers(vectors: np.ndarray, huge: bool, scale: int) -> np.ndarray:
    """Vectors as whole numbers of any length: huge ones are kept as they came, the others already as numbers."""
    exact = (lambda x: math.floor(Fraction(x) * scale)) if huge else int
    out = np.empty(vectors.shape, object)
    out[...] = np.array([exact(x) for x in vectors.ravel().tolist()], object).reshape(vectors.shape) if vectors.size else 0
    return out


def sound(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of double), dims; rows that are null or hold null or non-finite components, or have no vec_id, are left out."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.size("embedding").alias("dims"))


PARTS = "dims int, huge boolean, ids binary, rows binary, low binary, high binary, left binary, spans binary"


def dealt(rows: DataFrame, size: int, scale: int, trees: bool) -> DataFrame:
    """Rows dealt to parts of about `size` rows: PARTS and n (a number of each part). Dealing goes round, so rows of one vec_id are spread as well."""
    parts = max(1, -(-rows.count() // size))

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for d in set(batch.column("dims").to_pylist()):
                b = batch.filter(pa.compute.equal(batch.column("dims"), d))
                held.setdefault(d, []).append((b.column("vec_id").to_numpy(zero_copy_only=False), b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d)))
        for d, pieces in sorted(held.items()):
            ids, x = np.concatenate([i for i, _ in pieces]).astype(np.int64), np.concatenate([v for _, v in pieces]).astype(float)
            with np.errstate(over="ignore"):
                v = np.floor(x * scale)
            large = (np.abs(v) > math.sqrt(2**53 / max(d, 1))).any(1)
            for huge in (False, True):
                if not (large == huge).any():
                    continue
                i, w = ids[large == huge], (x if huge else v)[large == huge]
                if trees and not huge:
                    tree = Tree(w)
                    columns = [i[tree.order].tobytes(), *tree.packed()]
                else:
                    columns = [i.tobytes(), w.tobytes(), None, None, None, None]
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([huge], pa.bool_()), *(pa.array([c], pa.binary()) for c in columns)], ["dims", "huge", "ids", "rows", "low", "high", "left", "spans"])

    return rows.select("vec_id", "v", "dims").repartition(parts).mapInArrow(run, PARTS).withColumn("n", F.monotonically_increasing_id())


def exact_best(q: np.ndarray, rows: np.ndarray, ids: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """The k best (score, -id) by whole numbers, within the limits of a long."""
    return heapq.nlargest(k, ((min(max(int(s), LIMITS[0]), LIMITS[1]), -int(i)) for s, i in zip(rows @ q if rows.shape[1] else [0] * len(rows), ids, strict=True) if i != own))


def search(pairs: DataFrame, k: int, scale: int) -> DataFrame:
    """block, query_id, vec_id, score: for each pair of a shard and a block, each query's k best of the shard that reach the query's least score."""

    def run(batches):
        carried: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                own, q_ids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["q_ids"], np.int64)
                q = np.frombuffer(r["q_rows"], float).reshape(len(q_ids), r["dims"])
                out: list[tuple[int, int, int]] = []
                if r["huge"] or r["q_huge"]:
                    rows, q = whole_numbers(np.frombuffer(r["rows"], float).reshape(len(own), r["dims"]), r["huge"], scale), whole_numbers(q, r["q_huge"], scale)
                    for at, mine in enumerate(q_ids.tolist()):
                        out += [(mine, -m, s) for s, m in exact_best(q[at], rows, own, mine, k)]
                else:
                    tree = Tree.unpacked(r["rows"], r["low"], r["high"], r["left"], r["spans"], r["dims"], len(own))
                    least = carried.pop(r["block"], None)
                    if least is None:
                        least = np.frombuffer(r["least"], float).copy() if r["least"] else np.full(len(q_ids), -np.inf)
                    for start in range(0, len(q_ids), 512):
                        for at, bounds in enumerate(tree.bounds(q[start : start + 512]), start):
                            found = tree.search(q[at], bounds, own, int(q_ids[at]), k, least[at])
                            if len(found) == k:
                                least[at] = max(least[at], min(found)[0])
                            out += [(int(q_ids[at]), -m, s) for s, m in found]
                    carried[r["block"]] = least
                    if len(carried) > CARRIED:
                        carried.pop(next(iter(carried)))
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]] * len(out), pa.int64()), *(pa.array([o[j] for o in out], pa.int64()) for j in range(3))], ["block", "query_id", "vec_id", "score"])

    return pairs.select("dims", "huge", "ids", "rows", "low", "high", "left", "spans", "block", "q_huge", "q_ids", "q_rows", "least").mapInArrow(run, "block long, query_id long, vec_id long, score long")


def with_least(blocks: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """blocks with the kth score of each of their queries, as doubles in the order of q_ids, where the first search found k."""
    kth = found.groupBy("block", "query_id").agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
    by = stored(kth.groupBy("block").agg(F.collect_list(F.struct("query_id", "score")).alias("kth")), "kdtree-kth")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                known = {x["query_id"]: x["score"] for x in row.column("kth")[0].as_py() or []}
                least = np.array([known.get(x, -np.inf) for x in np.frombuffer(row.column("q_ids")[0].as_py(), np.int64).tolist()], float)
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in ("dims", "q_huge", "q_ids", "q_rows", "block")), pa.array([least.tobytes()], pa.binary())], ["dims", "q_huge", "q_ids", "q_rows", "block", "least"])

    return blocks.join(by, "block", "left").select("dims", "q_huge", "q_ids", "q_rows", "block", "kth").mapInArrow(run, "dims int, q_huge boolean, q_ids binary, q_rows binary, block long, least binary")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """At most k rows a query, by score, then smaller vec_id; rank from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = SCALE, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query with every other row.

    Queries are the rows whose vec_id is divisible by `every`; of rows that repeat such a vec_id the smallest vector is the query. Null vectors
    and vectors with null or non-finite components take no part, neither do rows without a vec_id; vectors only meet those of
    their own length. A query with fewer than k others gets all of them. Rows that repeat a
    vec_id are candidates of their own, save for the query with that vec_id. Components of any finite size are multiplied exactly; scores
    beyond a long are given as its limit and tie there. An empty table gives an empty result.
    """
    rows = stored(sound(vectors), "kdtree-rows")
    shards = stored(dealt(rows, SHARD_ROWS, scale, True), "kdtree-shards")
    wanted = stored(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "dims")).alias("q")).select("vec_id", "q.v", "q.dims"), "kdtree-queries")
    blocks = stored(dealt(wanted, block, scale, False).select("dims", F.col("huge").alias("q_huge"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("n").alias("block")), "kdtree-blocks")
    # Each block's first shard: blocks go round the shards of their length.
    light = shards.where("NOT huge").select("dims", "n").withColumn("at", F.row_number().over(Window.partitionBy("dims").orderBy("n")) - 1)
    counts = stored(light.groupBy("dims").agg(F.count(F.lit(1)).alias("of")), "kdtree-counts")
    first = blocks.where("NOT q_huge").join(counts, "dims").withColumn("at", F.pmod(F.xxhash64("block"), F.col("of"))).join(light, ["dims", "at"])
    first = first.select("n", "block", "q_huge", "q_ids", "q_rows", F.lit(None).cast("binary").alias("least")).join(shards, "n")
    seen = stored(search(first, k, scale), "kdtree-first")
    least = stored(with_least(blocks, seen, k), "kdtree-least")
    size = least.agg(F.coalesce(F.sum(F.length("q_rows") + F.length("q_ids") + F.length("least")), F.lit(0)).alias("size")).first().size
    if size <= BROADCAST_BYTES:
        pairs = shards.join(F.broadcast(least), "dims")
    else:
        both = shards.select("dims", "n").join(F.broadcast(least.select("dims", "block")), "dims").select("n", "block")  # one row of numbers for each block
        pairs = both.join(least.drop("dims").hint("merge"), "block").join(shards.hint("merge"), "n")
    return ranked(stored(search(pairs, k, scale), "kdtree-found"), k)
