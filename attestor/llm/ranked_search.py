"""Ranked lexical search: the best documents for each item by summed term impacts, with sort-based accumulation.

A first pass counts each document's terms and keeps those that items have, a row of postings a document. Counts over all documents give each
term its weight. A second pass goes over the postings in ranges of documents: for each posting the items of its term are looked
up, the (item, document, impact) arrays are concatenated, keys of item and document packed into one number are radix sorted, impacts of equal
keys are summed by reduceat, and each item's heap takes what may be among its best. A document lies in one range, so sums are final where
they are made; only each range's best are shuffled.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.llm.work import pieces, stored

#: Best documents that an item gets.
BEST = 10
#: Items are searched for in blocks of about so many, and so many bytes of text: what workers hold of items is bounded by these.
BLOCK_ITEMS, BLOCK_BYTES = 4096, 16 << 20
#: (item, document, impact) triples that are sorted at once, unless a single document makes more.
TRIPLES = 1 << 20
#: Bytes of a text that are cut into terms at once.
PIECE = 1 << 20
#: Parameters of the score: impacts are in units of 1 / SCALE, SATURATION and LENGTH_SHARE per cent as in BM25's k1 and b.
WEIGHT_SCALE, IMPACT_SCALE, TF_SCALE, SATURATION, LENGTH_SHARE = 1000, 10**9, 1000, 8, 75

#: Bytes as terms have them: A-Z lower-cased, digits and all beyond ASCII as they are, anything else a space.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def counted(text: bytes) -> Counter:
    """Occurrences of each term of a UTF-8 text, cut piece by piece."""
    folded, start, out = text.translate(FOLDED), 0, Counter()
    while start < len(folded):
        end = folded.find(b" ", start + PIECE)
        end = len(folded) if end < 0 else end
        out.update(folded[start:end].split())
        start = end
    return out


class Items:
    """A block of items: its terms, and for each the items that have it with how often they do."""

    def __init__(self, rows: list[tuple[int | None, bytes]]):
        self.ids, self.terms = [r[0] for r in rows], {}
        by_term: list[list[tuple[int, int]]] = []
        for at, (_, text) in enumerate(rows):
            for term, n in counted(text).items():
                k = self.terms.setdefault(term, len(self.terms))
                if k == len(by_term):
                    by_term.append([])
                by_term[k].append((at, n))
        flat = [x for having in by_term for x in having]
        self.items, self.repeats = np.array([x[0] for x in flat], np.int64), np.array([x[1] for x in flat], np.int64)
        self.counts = np.array([len(having) for having in by_term], np.int64)
        self.starts = np.cumsum(self.counts) - self.counts


def postings(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """doc_id, n (its terms), terms (numbers of those that items have) and counts for each document with a term."""

    def run(batches):
        for batch in pieces(batches):
            ids, sizes, offsets, found, tfs = [], [], [0], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                count = counted(text or b"")
                if not count:
                    continue
                ids.append(doc_id)
                sizes.append(count.total())
                for term, n in count.items():
                    k = terms.get(term)
                    if k is not None:
                        found.append(k)
                        tfs.append(n)
                offsets.append(len(found))
            at = pa.array(offsets, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, t)) for x, t in ((found, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


def radix_order(keys: np.ndarray, most: int) -> np.ndarray:
    """The stable order of keys from 0 to most, by digits of 16 bits from the lowest; numpy sorts those by counting."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    shift = 16
    while most >> shift:
        digit = (keys >> shift).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]
        shift += 16
    return order


def accumulated(items: Items, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """item, document and summed impact of every pair that shares a term. doc: numbers below `docs` of the documents that the postings are of."""
    n = items.counts[term]
    own = np.repeat(np.arange(len(term)), n)
    at = items.starts[term][own] + np.arange(len(own)) - (np.cumsum(n) - n)[own]
    keys = items.items[at] * docs + doc[own]
    values = impact[own] * items.repeats[at]
    if not len(keys):
        return keys, keys, values
    order = radix_order(keys, len(items.ids) * docs)
    keys, values = keys[order], values[order]
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[heads] // docs, keys[heads] % docs, np.add.reduceat(values, heads)


def cuts(triples: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of documents that make about TRIPLES triples each, a document at least."""
    out, start, total = [], 0, np.concatenate(([0], np.cumsum(triples)))
    while start < len(triples):
        end = max(start + 1, int(np.searchsorted(total, total[start] + TRIPLES, "right")) - 1)
        out.append((start, end))
        start = end
    return out


def best_of_ranges(rows: DataFrame, items: Items, weights: np.ndarray, with_terms: int, all_terms: int, best: int) -> DataFrame:
    """item (its number in the block), item_id, doc_id, score: each task's best documents for each item."""

    def run(batches):
        heaps: dict[int, list] = {}
        least = np.zeros(len(items.ids), np.int64)
        for batch in batches:
            lengths = pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False)
            terms = batch.column("terms").flatten().to_numpy(zero_copy_only=False)
            tf = batch.column("counts").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            ids = batch.column("doc_id").to_pylist()
            m = 100 - LENGTH_SHARE + LENGTH_SHARE * n * with_terms // all_terms
            ends = np.concatenate(([0], np.cumsum(lengths)))
            doc = np.repeat(np.arange(len(n)), lengths)
            impact = weights[terms] * (IMPACT_SCALE * tf // (TF_SCALE * tf + SATURATION * m[doc]))
            made = np.concatenate(([0], np.cumsum(items.counts[terms])))[ends]
            for a, b in cuts(np.diff(made)):
                p = slice(ends[a], ends[b])
                item, at, score = accumulated(items, doc[p] - a, terms[p], impact[p], b - a)
                may = (score > 0) & (score >= least[item])
                for i, d, s in zip(item[may].tolist(), at[may].tolist(), score[may].tolist(), strict=True):
                    heap, doc_id = heaps.setdefault(i, []), ids[a + d]
                    entry = (s, doc_id is not None, -(doc_id or 0))
                    if len(heap) < best:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                    if len(heap) == best:
                        least[i] = heap[0][0]
        out = [(i, items.ids[i], -d if known else None, s) for i, heap in heaps.items() for s, known, d in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(4)], ["item", "item_id", "doc_id", "score"])

    return rows.mapInArrow(run, "item long, item_id long, doc_id long, score long")


def weights_of(rows: DataFrame, terms: int, with_terms: int) -> np.ndarray:
    """Each term's weight from the number of documents that have it."""
    df = np.zeros(terms, np.int64)
    for r in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each of the block's terms at most
        df[r.term] = r.n
    return np.floor(WEIGHT_SCALE * np.log((2 * with_terms + 2) / (2 * df + 1))).astype(np.int64)


def blocks(items: DataFrame) -> Iterator[list[tuple[int | None, bytes]]]:
    """Items in blocks that fit a worker, each taken to the driver when it is its turn."""
    rows = stored(items.select("item_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")), "search-items")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    count = max(1, -(-size.n // BLOCK_ITEMS), -(-size.bytes // BLOCK_BYTES))
    dealt = stored(rows.repartition(count).withColumn("block", F.spark_partition_id()), "search-blocks")
    for b in range(count):
        yield [(r.item_id, bytes(r.text)) for r in dealt.where(F.col("block") == b).collect()]


def ranked(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """item_id, rank, doc_id, score: each item's `best` documents with a score above 0, equal scores by ascending doc_id.

    docs: doc_id, text; items: item_id, text. Terms are runs of ASCII letters (lower-cased), digits and anything beyond ASCII. Null and
    empty texts have no term: such documents are not counted, such items get no row. Rows that repeat a doc_id are documents of their own, those that
    repeat an item_id are ranked each by itself; a null doc_id comes last among equal scores. Either table empty gives an empty result.
    """
    found = []
    for block in blocks(items):
        own = Items(block)
        rows = stored(postings(docs, own.terms), "search-postings")
        total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        weights = weights_of(rows, len(own.terms), total.n)
        kept = best_of_ranges(rows.where(F.size("terms") > 0), own, weights, total.n, max(total.terms, 1), best)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = stored(kept, "search-best").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")
        found.append(top)
    return reduce(DataFrame.union, found)
