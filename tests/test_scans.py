"""Scans over arrays, packing and block grouping against plain folds, and on long inputs."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from attestor.functions import arrays
from attestor.operators import extraction, layout
from attestor.operators import passages as P


def test_running_sums_and_chains(spark):
    rng = random.Random(1)
    rows = [([rng.randrange(50) for _ in range(n)], [rng.randint(i + 1, i + 5) for i in range(n)]) for n in [0, 1, 2, 3, 7, 8, 9, 100]]
    df = spark.createDataFrame(rows, "xs array<int>, follows array<int>")
    for (xs, follows), got in zip(rows, df.select(arrays.running(F.col("xs")).alias("s"), arrays.chain(F.col("follows")).alias("c")).collect(), strict=True):
        assert got.s == list(np.cumsum(xs)) or not xs and got.s == []
        want, at = [], 0
        while at < len(xs):
            want.append(at)
            at = follows[at]
        assert got.c == want


def folded(words, most):
    out = []
    for i, w in enumerate(words):
        if out and out[-1][2] + w <= most:
            out[-1] = (out[-1][0], i + 1, out[-1][2] + w)
        else:
            out.append((i, i + 1, w))
    return out


def test_packing_is_the_greedy_fold(spark):
    rng = random.Random(2)
    rows = [[rng.choice([0, 1, 5, 300, 999, 1000, 1001, 2500]) for _ in range(n)] for n in [0, 1, 2, 3, 10, 60, 200]]
    df = spark.createDataFrame([([(i, i + 1, w) for i, w in enumerate(r)],) for r in rows], "x array<struct<start:int,end:int,words:int>>")
    for r, got in zip(rows, df.select(P.packed(F.col("x")).alias("p")).collect(), strict=True):
        assert [tuple(s) for s in got.p] == folded(r, 1000)


def requests(words):
    out, total = [], 0
    for i, w in enumerate(words):
        if out and total + w <= extraction.REQUEST_WORDS and len(out[-1]) < extraction.REQUEST_PASSAGES:
            out[-1].append(i)
            total += w
        else:
            out.append([i])
            total = w
    return out


def test_requests_are_the_greedy_fold(spark):
    rng = random.Random(3)
    docs = {f"d{n}": [rng.choice([1, 100, 300, 400, 1200, 1201]) for _ in range(n)] for n in (1, 2, 5, 40)}
    rows = [(d, f"{d}_{i:03d}", "w " * w, True) for d, ws in docs.items() for i, w in enumerate(ws)]
    df = spark.createDataFrame([*rows, ("d1", "d1_999", "w", False)], "doc_id string, chunk_id string, text string, was_sent_to_llm boolean")
    got = {r.request_id: r.chunk_ids for r in extraction.packed(df).collect()}
    assert got == {f"{d}__r{k:04d}": [f"{d}_{i:03d}" for i in ids] for d, ws in docs.items() for k, ids in enumerate(requests(ws))}


def test_long_documents_take_near_linear_time(spark):
    def seconds(n):
        df = spark.range(n).select(F.lit("d").alias("doc_id"), F.format_string("c%07d", "id").alias("chunk_id"), F.lit("three words here").alias("text"), F.lit(True).alias("was_sent_to_llm")).coalesce(1)
        spans = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.cast("int").alias("start"), (i + 1).cast("int").alias("end"), F.lit(400).alias("words"))).alias("x"))
        start = time.time()
        assert extraction.packed(df).count() == -(-n // 4)
        assert spans.select(F.size(P.packed(F.col("x"))).alias("n")).first().n == n // 2
        return time.time() - start

    seconds(100)
    small, large = seconds(12_500), seconds(100_000)
    assert large < 24 * small + 5 and large < 60


def block_fold(boxes):
    built, chosen = [], []
    for left, right, top, bottom in boxes:
        best, least = -1, None
        for i, (bl, br, bb, bh) in enumerate(built):
            narrower, overlap, gap = max(1.0, min(right - left, br - bl)), min(right, br) - max(left, bl), top - bb
            beside = max(0.0, -overlap) <= layout.TOUCH if narrower <= layout.NARROW else overlap > 0 and overlap / narrower >= layout.OVERLAP
            if beside and (gap <= 0 or gap <= min(bh, bottom - top) + layout.GAP_SLACK) and (least is None or gap < least):
                best, least = i, gap
        if best < 0:
            best = len(built)
            built.append([left, right, bottom, bottom - top])
        else:
            bl, br, bb, bh = built[best]
            built[best] = [min(bl, left), max(br, right), max(bb, bottom), min(bh, bottom - top)]
        chosen.append(best)
    return chosen


def page(rng, n, height):
    tops = sorted(float(rng.randrange(int(height))) for _ in range(n))
    out = []
    for top in tops:
        left = float(rng.randrange(0, 560))
        out.append((left, left + rng.choice([3, 10, 40, 45, 46, 150, 400]), top, top + rng.choice([-4, 0, 2, 8, 10, 24])))
    return out


def test_sweep_is_the_fold_over_all_blocks():
    rng = random.Random(4)
    for n, height in [(0, 10), (1, 10), (30, 100), (200, 300), (400, 6000), (500, 40_000)]:
        boxes = page(rng, n, height)
        assert layout.grouped(boxes) == block_fold(boxes)
        rng.shuffle(boxes)  # lines in any order
        assert layout.grouped(boxes) == block_fold(boxes)


def test_a_page_of_many_lines_is_swept_in_near_linear_time():
    rng = random.Random(5)
    boxes = page(rng, 20_000, 200_000)
    start = time.time()
    assert max(layout.grouped(boxes)) > 1000
    assert time.time() - start < 10
