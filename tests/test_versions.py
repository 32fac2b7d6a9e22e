"""Versions: whole changes, deletes down the links, conflicts, failures, and readers during a change."""

import random

import pytest
from pyspark.sql import functions as F

from attestor.sources import versions as V


@pytest.fixture
def store(spark, tmp_path):
    return V.Versions(spark, f"file://{tmp_path}/tables")


def filled(spark, docs=range(40)):
    """Rows of all tables: each document has 2 pages, 3 chunks and 6 facts of 5 entities; facts of one entity are related in a ring."""
    docs = list(docs)
    facts = [(f"f{d}_{i}", f"c{d}_{i % 3}", f"d{d}", f"e{(d + i) % 5}") for d in docs for i in range(6)]
    by = {}
    for f in facts:
        by.setdefault(f[3], []).append(f[0])
    relations = [(f"r_{a}_{b}", a, b, c, e) for e, fs in by.items() for a, b, c in zip(fs, fs[1:], [None, *fs], strict=False)]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "documents": make([(f"d{d}",) for d in docs], "doc_id string"),
        "pages": make([(f"p{d}_{i}", f"d{d}", "text") for d in docs for i in range(2)], "page_id string, doc_id string, text string"),
        "chunks": make([(f"c{d}_{i}", f"d{d}") for d in docs for i in range(3)], "chunk_id string, doc_id string"),
        "facts": make(facts, "fact_id string, chunk_id string, doc_id string, entity_id string"),
        "relations": make(relations, "relation_id string, fact_a string, fact_b string, bridging_fact_id string, entity_id string"),
    }


def put(store, tables):
    change = store.change()
    for name, rows in tables.items():
        change.replace(name, rows)
    return change.commit()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_deletes_follow_the_links(spark, store):
    tables = filled(spark)
    put(store, tables)
    want = {n: rows(df) for n, df in tables.items()}
    change = store.change()
    gone = change.delete("documents", spark.createDataFrame([("d3",), ("d17",), ("d3",), ("none",)], "doc_id string"))
    dead = {"d3", "d17"}
    facts = {f for f, _, d, _ in want["facts"] if d in dead}
    assert {r.fact_id for r in gone["facts"].collect()} == facts
    assert rows(change.read("documents")) == [r for r in want["documents"] if r[0] not in dead]
    for name in ("pages", "chunks"):
        assert rows(change.read(name)) == [r for r in want[name] if r[1] not in dead]
    assert rows(change.read("facts")) == [r for r in want["facts"] if r[2] not in dead]
    left = sorted(((r, a, b, None if c in facts else c, e) for r, a, b, c, e in want["relations"] if a not in facts and b not in facts), key=str)
    assert rows(change.read("relations")) == left and len(left) < len(want["relations"])
    assert any(c in facts and a not in facts and b not in facts for _, a, b, c, _ in want["relations"])
    assert {n: rows(store.at().read(n)) for n in want} == want  # nothing is seen before the commit
    change.commit()
    assert rows(store.at().read("relations")) == left and rows(store.at(1).read("relations")) == want["relations"]


def test_chunks_take_their_facts_along(spark, store):
    put(store, filled(spark, range(5)))
    change = store.change()
    change.delete("chunks", spark.createDataFrame([("c2_1",)], "chunk_id string"))
    assert {r.fact_id for r in store.at().read("facts").collect()} - {r.fact_id for r in change.read("facts").collect()} == {"f2_1", "f2_4"}
    assert change.read("pages").count() == 10


def test_only_touched_buckets_are_written(spark, store):
    put(store, filled(spark, range(400)))
    before = store.at().tables["pages"]["buckets"]
    change = store.change()
    change.delete("documents", spark.createDataFrame([("d3",)], "doc_id string"))
    after = change.tables["pages"]["buckets"]
    assert sum(before.get(b) != after.get(b) for b in set(before) | set(after)) == 1


def test_a_reader_sees_one_version_while_others_are_made(spark, store):
    put(store, filled(spark, range(6)))
    reader = store.at()
    pages, facts = reader.read("pages"), reader.read("facts")
    change = store.change()
    change.delete("documents", spark.createDataFrame([("d1",)], "doc_id string"))
    middle = {n: store.at().read(n).count() for n in ("documents", "pages", "facts")}
    change.commit()
    assert middle == {"documents": 6, "pages": 12, "facts": 36}
    assert pages.count() == 12 and facts.count() == 36 and reader.read("relations").count() > 0
    assert {n: store.at().read(n).count() for n in middle} == {"documents": 5, "pages": 10, "facts": 30}


def test_a_failed_change_leaves_the_old_version(spark, store):
    put(store, filled(spark, range(6)))
    change = store.change()
    change.replace("documents", spark.createDataFrame([("new",)], "doc_id string"))
    broken = store.at().read("pages").withColumn("text", F.raise_error(F.lit("broken page")))
    with pytest.raises(Exception, match="broken page"):
        change.replace("pages", broken)
    assert store.latest() == 1 and store.at().read("documents").count() == 6
    assert store.vacuum() >= 1
    assert {n: store.at().read(n).count() for n in ("documents", "pages")} == {"documents": 6, "pages": 12}


def test_the_second_of_two_changes_fails(spark, store):
    put(store, filled(spark, range(4)))
    first, second = store.change(), store.change()
    first.append("documents", spark.createDataFrame([("a",)], "doc_id string"))
    second.append("documents", spark.createDataFrame([("b",)], "doc_id string"))
    assert first.commit() == 2
    with pytest.raises(V.Conflict):
        second.commit()
    assert {r.doc_id for r in store.at().read("documents").collect()} == {"d0", "d1", "d2", "d3", "a"}
    assert not [n for n in store.listed("_versions") if n.startswith(".")]


def test_appends_are_put_together_and_vacuum_keeps_what_is_named(spark, store, monkeypatch):
    monkeypatch.setattr(V, "MOST_FOLDERS", 3)
    monkeypatch.setattr(V, "BUCKETS", 2)
    want, rng = [], random.Random(1)
    for i in range(8):
        part = [(f"d{i}_{k}",) for k in range(rng.randint(0, 9))]
        want += part
        change = store.change()
        change.append("documents", spark.createDataFrame(part, "doc_id string"))
        change.commit()
    assert rows(store.at().read("documents")) == sorted(want, key=str)
    assert all(len(f) <= 3 for f in store.at().tables["documents"]["buckets"].values())
    assert store.vacuum(keep=2) > 0
    assert rows(store.at().read("documents")) == sorted(want, key=str) and store.at(7).read("documents").count() > 0
    with pytest.raises(Exception, match="0000000003"):
        store.at(3)


def test_empty_tables_keep_their_columns(spark, store):
    change = store.change()
    change.replace("pages", spark.createDataFrame([], "page_id string, doc_id string, text string"))
    change.commit()
    assert store.at().read("pages").columns == ["page_id", "doc_id", "text"] and store.at().read("pages").isEmpty()
