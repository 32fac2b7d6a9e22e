"""Ranked search against scores by hand and SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from attestor.llm import oracles, ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items, best=10):
    own = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_terms = len(own), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, c in own:
            m = 100 - 75 + (75 * c.total() * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, rank, None if null else d, -s) for rank, (s, null, d) in enumerate(sorted(scores)[:best], 1)]
    return sorted(out, key=str)


def corpus(seed, n, words):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aAbé9ß_ -") for _ in range(rng.randint(1, 4))) for _ in range(words)]
    text = lambda k: " ".join(vocabulary[min(int(rng.expovariate(6 / words)), words - 1)] for _ in range(k))
    return [(i, text(rng.choice([0, 1, 5, 40, 200]))) for i in range(n)], [(i, text(rng.choice([0, 1, 3, 12]))) for i in range(25)]


@pytest.mark.parametrize("triples, block", [(1 << 20, 4096), (50, 7)])
def test_ranked_equals_scores_by_hand(spark, monkeypatch, triples, block):
    monkeypatch.setattr(ranked_search, "TRIPLES", triples)
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", block)
    docs, items = corpus(triples, 300, 60)
    docs += [(None, "a é"), (None, "a é"), (7, docs[7][1]), (1000, None), (1001, "…!"), (1002, "K K İ"), (1003, "\x00a\x00"), (1004, "b " * 30000)]
    items += [(50, None), (51, "a a a b"), (51, "a a a b"), (None, "é"), (52, "K k"), (53, "nowhere")]
    got = ranked_search.ranked(spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int, terms string").repartition(5), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()), key=str) == expected(docs, items)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.ranked(none[0], some[1]).count() == 0
    assert ranked_search.ranked(some[0], none[1]).count() == 0
    assert ranked_search.ranked(some[0].selectExpr("doc_id", "CAST(NULL AS STRING) AS text"), some[1]).count() == 0


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(ranked_search, "PIECE", 5)
    text = "abc defghijklmnop, éé q" * 20
    assert {k.decode(): n for k, n in ranked_search.counted(text.encode()).items()} == Counter(terms(text))


def test_radix_order_is_the_stable_order():
    rng = np.random.default_rng(1)
    for most in (5, 1 << 16, 1 << 33):
        keys = rng.integers(0, most, 3000)
        assert (ranked_search.radix_order(keys, most) == np.argsort(keys, kind="stable")).all()


def test_sql_gives_the_same(spark):
    docs, items = corpus(4, 120, 80)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    assert sorted(con.execute(oracles.ORACLES["op13_ranked_search"]).fetchall(), key=str) == expected(docs, items)
