"""Scans over arrays by doubling steps: each step is one pass over the array, so n elements take n log n, not n squared as a fold that appends does."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestor.functions.parsing import bound

POWERS = [1 << k for k in range(31)]


def powers_below(n: Column) -> Column:
    """1, 2, 4, … below n."""
    return F.filter(F.array(*map(F.lit, POWERS)), lambda p: p < n)


def running(xs: Column) -> Column:
    """Sums (long) of an array's first 1, 2, … elements."""
    step = lambda sums, p: F.transform(sums, lambda x, i: x + F.when(i >= p, F.get(sums, i - p)).otherwise(0))
    return bound(xs.cast("array<long>"), lambda of: F.aggregate(powers_below(F.size(of)), of, step))


def chain(follows: Column) -> Column:
    """0, follows[0], follows[follows[0]], … as long as they are places in the array. follows: int places greater than their own."""

    def walk(of: Column) -> Column:
        n = F.size(of)
        state = F.struct(of.alias("jump"), F.array(F.lit(0)).alias("seen"))

        def step(s: Column, _: Column) -> Column:
            on = F.filter(F.transform(s["seen"], lambda x: F.get(s["jump"], x)), lambda x: x < n)
            return F.struct(F.transform(s["jump"], lambda x: F.coalesce(F.get(s["jump"], x), x)).alias("jump"), F.concat(s["seen"], on).alias("seen"))

        return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.aggregate(powers_below(n), state, step, lambda s: s["seen"]))

    return bound(follows.cast("array<int>"), walk)


def reach(sums: Column, start: Column, most: int) -> Column:
    """The first place from which on the elements from `start` add up to more than `most`, but `start` + 1 at least. sums: running() of elements that aren't negative."""
    before = F.when(start > 0, F.get(sums, start - 1)).otherwise(0)
    fits = lambda at, p: (at + p <= F.size(sums)) & (F.get(sums, at + p - 1) - before <= most)
    end = F.aggregate(F.reverse(powers_below(F.size(sums) + 1)), start, lambda at, p: F.when(fits(at, p), at + p).otherwise(at))
    return F.greatest(end, start + 1)


def runs(starts: Column, n: Column) -> Column:
    """(start, end) of the runs that begin at `starts` and cover n places."""
    return F.transform(starts, lambda s, k: F.struct(s.alias("start"), F.coalesce(F.get(starts, k + 1), n).alias("end")))
