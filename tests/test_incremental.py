"""Uploads, replacements and removals against a corpus built anew each time."""

import json
import random

from pyspark.sql import functions as F

from attestor.operators import adjudication
from attestor.plans import incremental as I
from attestor.plans.registry import normalised
from attestor.plans.settings import Settings
from attestor.sources import adapters, versions
from tests.test_pipeline_run import provider

RAW = "fact_id string, chunk_id string, doc_id string, page_no int, subject_raw string, attribute_raw string, value_raw string, value_kind string, value_text string, unit string, currency string, period_raw string, as_of_raw string, scope_raw string, source_kind string, confidence double, evidence_text string, grounded boolean"


def document(rng, d, version=0):
    """A document's pages, passages and claims: few entities and attributes, values that agree, differ, and explain gaps."""
    rows = []
    for i in range(rng.randint(4, 14)):
        e = rng.choice(["Harrow Lines", "Harrow Line", "Harrow Lines Ltd", "Oakfield", "Oakfield Works", "Mill No 7", "the company"])
        kind = rng.random()
        value = rng.choice([1000, 1000, 1400, 400, 2500, 1100, 100])
        text = kind < 0.15
        raw = rng.choice(["appointed", "resigned"]) if text else str(value)
        rows.append((f"d{d}__v{version}_f{i}", f"d{d}__c{i % 2}", f"d{d}", 1, e, rng.choice(["vans run", "vans runs", "net vans", "sheds"]), raw, "text" if text else "number", raw if text else None, None, None,
                     rng.choice([None, None, "year ended 31 March 2020", "FY 2021"]), rng.choice([None, "31 March 2020"]), rng.choice([None, "without leased vans"]), "prose", rng.choice([0.5, 0.9]), raw, True))
    return [(f"d{d}", 1, "text")], [(f"d{d}__c{k}", f"d{d}") for k in range(2)], rows


def frames(spark, docs):
    parts = [sum((list(d[k]) for d in docs), []) for k in range(3)]
    return spark.createDataFrame(parts[0], "doc_id string, page_no int, raw_text string"), spark.createDataFrame(parts[1], "chunk_id string, doc_id string"), spark.createDataFrame(parts[2], RAW)


def content(corpus):
    at = corpus.store.at()
    out = {}
    for name in ("documents", "pages", "chunks", "facts", "relations", "subjects", "families", "entities", "attribute_families"):
        df = at.read(name)
        out[name] = sorted((json.dumps(r.asDict(True), default=str, sort_keys=True) for r in df.collect()))
    return out


def few_files(spark, monkeypatch):
    """Few buckets and partitions, as the tables are tiny."""
    monkeypatch.setattr(versions, "BUCKETS", 2)
    spark.conf.set("spark.sql.shuffle.partitions", "1")


def test_ten_uploads_equal_a_corpus_built_at_once(spark, tmp_path, monkeypatch, request):
    request.addfinalizer(lambda: spark.conf.set("spark.sql.shuffle.partitions", "4"))
    few_files(spark, monkeypatch)
    rng = random.Random(8)
    corpus = I.Corpus(spark, f"file://{tmp_path}/grown", settings=Settings(bucket_cap=9))
    have = {}
    steps = [[0, 1], [2], [3], [1], [4, 5], ["-2"], [0, 6], [7], ["-1", "-4"], [8, 2]]
    bridged = set()
    for n, step in enumerate(steps):
        if isinstance(step[0], str):
            for d in step:
                del have[int(d[1:])]
            corpus.remove(spark.createDataFrame([(f"d{d[1:]}",) for d in step], "doc_id string"))
        else:
            made = {d: document(rng, d, n) for d in step}
            have |= made
            corpus.add(*frames(spark, list(made.values())))
        now = corpus.store.at()
        rows = lambda df: sorted(str(r) for r in df.select(*I.RELATION).collect())
        assert rows(now.read("relations")) == rows(I.judged(now.read("facts"), 9))
        assert {r.fact_id for r in now.read("facts").collect()} == {f[0] for d in have.values() for f in d[2]}
        if n == len(steps) - 1:
            whole = I.Corpus(spark, f"file://{tmp_path}/whole{n}", settings=Settings(bucket_cap=9))
            whole.add(*frames(spark, list(have.values())))
            assert content(corpus) == content(whole)
        bridged |= {r.leaf for r in corpus.store.at().read("relations").select("leaf").distinct().collect()}
    assert corpus.store.latest() == len(steps)
    assert {"R13", "R15", "R10"} <= bridged


def test_only_buckets_of_touched_entities_are_read(spark, tmp_path):
    values = [(f"f{e}_{i}", f"d{i}", f"e{e}", f"fam{i % 2}", float(100 + 7 * e + 60 * i)) for e in range(300) for i in range(6)]
    facts = spark.createDataFrame(values, "fact_id string, doc_id string, entity_id string, attribute_family string, value_num double")
    plain = {c: F.lit(None).cast(t) for c, t in (("value_text", "string"), ("unit", "string"), ("currency", "string"), ("period_start", "date"), ("period_end", "date"), ("as_of_date", "date"), ("scope_raw", "string"), ("scope_tags", "array<string>"), ("period_raw", "string"), ("as_of_raw", "string"))}
    facts = facts.withColumns(plain | {"page_no": F.lit(1), "confidence": F.lit(0.9), "grounded": F.lit(True), "value_raw": F.col("value_num").cast("string"), "attribute_raw": F.col("attribute_family")})
    corpus = I.Corpus(spark, f"file://{tmp_path}/c")
    change = corpus.store.change()
    change.replace("facts", facts)
    change.replace("relations", I.judged(facts))
    change.commit()
    before = corpus.store.at()
    change = corpus.store.change()
    fresh = facts.where("fact_id = 'f17_3'").withColumns({"value_num": F.lit(5.0), "value_raw": F.lit("5")})
    read = I.delta(change, fresh, facts.where("fact_id IN ('f40_1', 'f41_1')"))
    assert len(read["facts"]) <= 3
    for name in ("facts", "relations"):
        a, b = before.tables[name]["buckets"], change.tables[name]["buckets"]
        assert {k for k in a if a[k] != b.get(k)} <= {str(x) for x in read[name]}
    left = facts.where("fact_id NOT IN ('f17_3', 'f40_1', 'f41_1')").unionByName(fresh)
    rows = lambda df: sorted(str(r) for r in df.select(*I.RELATION).collect())
    assert rows(change.read("relations")) == rows(I.judged(left))


def test_uploads_of_lines(spark, tmp_path, monkeypatch, request):
    request.addfinalizer(lambda: spark.conf.set("spark.sql.shuffle.partitions", "4"))
    few_files(spark, monkeypatch)
    corpus = I.Corpus(spark, f"file://{tmp_path}/c", provider, Settings(requests_per_minute=1e6))
    lines, tables = (df.where("page_no < 3").cache() for df in (adapters.lines(spark, "/root/testdata/sf0.001"), adapters.raw_tables(spark, "/root/testdata/sf0.001")))
    part = lambda df, n: df.where(F.col("doc_id").isin(*n))
    first, second = ["d1", "d2"], ["d2", "d4"]
    for docs in (first, second):
        corpus.upload(part(lines, docs), part(tables, docs))
    whole = I.Corpus(spark, f"file://{tmp_path}/w", provider, Settings(requests_per_minute=1e6))
    every = sorted({*first, *second})
    whole.upload(part(lines, every), part(tables, every))
    assert corpus.store.latest() == 2 and corpus.store.at().read("documents").count() == len(every)
    got, want = content(corpus), content(whole)
    assert len(got["facts"]) > 0 and len(got["relations"]) > 0
    assert got["relations"] == want["relations"] and got["facts"] == want["facts"]
    assert {r.verdict for r in corpus.relations().collect()} <= {"corroborates", "contradicts", "reconciled", "superseded", "unrelated", "undecided"}


def test_only_gaps_and_proofs_look_for_other_facts(spark):
    """Stored relations equal those joined to their facts afterwards, while pairs without a proof are read as they were judged, without a join."""
    facts = normalised(spark, "/root/testdata/sf0.001")
    got, want = I.judged(facts), adjudication.adjudicated(facts)
    want = want.withColumns({k: F.coalesce(f"a.{k}", f"b.{k}") for k in I.KEYS} | {f"doc_{x}": F.col(f"{x}.doc_id") for x in ("a", "b")})
    plan = adjudication.verdicts(facts)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan.split("\n")[0] and plan.count("Join") == 1
    got, want = (df.select(*I.RELATION).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.count("explanation").alias("said"), F.sum(F.xxhash64(*I.RELATION).cast("decimal(38,0)")).alias("h")).collect() for df in (got, want))
    assert {tuple(r) for r in got} == {tuple(r) for r in want} and len(got) > 8
