"""Pairs of similar phrases against brute force."""

import random

import pytest

from attestor.functions.similarity import score
from attestor.operators import resolution as R


def variants(seed, n):
    rng = random.Random(seed)
    words = ["net", "revenue", "from", "parts", "total", "stock", "of", "segment", "growth", "é", "a", "region"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) + rng.choice(["", f" {rng.randrange(2000)}"]) for _ in range(n // 3)]
    out = {"", *base}
    while len(out) < n:
        t = list(rng.choice(base))
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(t) + 1)
            if rng.random() < 0.5 and t:
                t[at : at + 1] = []
            else:
                t[at:at] = rng.choice("abnert x")
        out.add("".join(t))
    return sorted({" ".join(sorted(x.split())) for x in out})


@pytest.mark.parametrize("least", [88.0, 93.0])
def test_edges_lead_from_the_phrase_ranked_first(spark, least):
    names = variants(int(least), 300)
    rng = random.Random(9)
    rank = {x: rng.randrange(10**6) for x in names}
    rows = [(x, x, rank[x], rank[x] % 3 > 0) for x in names]
    got = {(r.src, r.dst, round(r.score, 6)) for r in R.similar_phrases(spark.createDataFrame(rows, "phrase string, tidy string, place long, may_lead boolean"), least, []).collect()}
    assert got == {(a, b, round(score(a, b), 6)) for a in names for b in names if a and b and rank[a] < rank[b] and rank[a] % 3 > 0 and score(a, b) >= least}
