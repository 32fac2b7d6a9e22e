"""The Merkle manifest against a tree built by hand."""

import hashlib
import random
import zlib
from itertools import groupby

import duckdb
import pytest

from attestor.llm import merkle, oracles

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def climbed(values):
    """Root, and for each value its siblings from below to above."""
    paths, at, row = [[] for _ in values], list(range(len(values))), list(values)
    while len(row) > 1:
        for path, i in zip(paths, at, strict=True):
            path += [row[j] for j in (i ^ 1,) if j < len(row)]
        row = [sha("".join(row[i : i + 2])) for i in range(0, len(row), 2)]
        at = [i // 2 for i in at]
    return row[0], paths


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def expected(docs):
    """Sorted (doc_id, leaf, subroot, root, proof_sha256, verified)."""
    leaf = lambda r, more=0: sha("".join(map(field, (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1]))))
    rows = sorted(((r[2] is not None, (r[2] or "").encode(), r[0] is not None, r[0] or 0, leaf(r), r) for r in docs), key=lambda x: x[:5])
    trees = [[x for x in g] for _, g in groupby(rows, key=lambda x: x[:2])]
    made = [climbed([x[4] for x in t]) for t in trees]
    root, upper = climbed([m[0] for m in made])
    out = []
    for tree, (subroot, paths), tail in zip(trees, made, upper, strict=True):
        for x, path in zip(tree, paths, strict=True):
            doc_id, n = x[5][0], x[5][4]
            tampered = doc_id is not None and n is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
            out.append((doc_id, x[4], subroot, root, sha("".join(path + tail)), not tampered))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in df.collect()), key=str)


def corpus(n, langs, seed=3):
    rng = random.Random(seed)
    return [(i, rng.choice(["", "a\nb", "é😀 z", "x" * 5000, None]), rng.choice(langs), rng.choice([None, "s1", "s2"]), rng.choice([None, 0, 7, 2**63 - 1])) for i in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("n, langs", [(1, [None]), (2, ["en"]), (3, ["en", None]), (40, ["en", "de", "é", "", None]), (700, ["en"]), (1100, ["en", "en", "en", "zz", None])])
def test_manifest_is_the_tree_built_by_hand(spark, n, langs):
    docs = corpus(n, langs)
    df = spark.createDataFrame([(*r, "x", 1) for r in docs], DOCS + ", leaf string, place int")
    assert got(merkle.digests(df)) == expected(docs)


def test_many_trees_repeats_and_null_ids(spark):
    docs = [(None, "t", f"l{i % 300}", "s", 1) for i in range(600)] + corpus(100, ["en"]) * 3 + [(5, "same", "de", "s", 4)] * 500
    assert got(merkle.digests(spark.createDataFrame(docs, DOCS))) == expected(docs)


def test_empty_table(spark):
    assert merkle.digests(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("levels", [1, 3])
def test_rounds_of_any_height_give_the_same(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    docs = corpus(37, ["en", "de"])
    assert got(merkle.digests(spark.createDataFrame(docs, DOCS))) == expected(docs)


def test_frontiers_meet_in_any_order():
    rng = random.Random(1)
    for n in (1, 2, 5, 31, 200):
        values = [sha(str(i)) for i in range(n)]
        nodes = list(enumerate(values))
        rng.shuffle(nodes)
        parts = [merkle.opened(n) for _ in range(4)]
        for place, value in nodes:
            merkle.added(rng.choice(parts), 0, place, value)
        whole = merkle.opened(n)
        for part in parts:
            whole = merkle.merged(whole, part)
        assert (whole[1], whole[2]) == ({}, climbed(values)[0])


def test_a_changed_sibling_or_place_breaks_the_proof(spark):
    rows = merkle.manifest(spark.createDataFrame(corpus(21, ["en", "de"]), DOCS)).collect()
    for r in rows:
        steps = [(r.place, r.size), (r["rank"], r.trees)]
        assert merkle.folded(r.leaf, list(r.proof), steps) == r.root
        assert merkle.folded(r.leaf, [*r.proof[:-1], sha("other")], steps) != r.root
        assert merkle.folded(sha(r.leaf), list(r.proof), steps) != r.root


def test_sql_gives_the_same(spark, tmp_path):
    path = f"{tmp_path}/documents"
    docs = corpus(60, ["en", "de", None])
    spark.createDataFrame(docs, DOCS).coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    found = con.execute(oracles.ORACLES["op11_merkle"])
    names = [d[0] for d in found.description]
    at = [names.index(c) for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "verified")]
    rows = found.fetchall()
    assert sorted((tuple(r[i] for i in at) for r in rows), key=str) == expected(docs)
    folds = {r[names.index("doc_id")]: r[names.index("folded_root")] for r in rows}
    assert folds == {r.doc_id: r.folded_root for r in merkle.digests(spark.createDataFrame(docs, DOCS)).collect()}
