"""Grounding, resolution, pairing and the rule tree on small cases."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attestor.functions.similarity import lcs_length, score
from attestor.operators import adjudication as A
from attestor.operators import extraction as E
from attestor.operators import grounding as G
from attestor.operators import pairing as P
from attestor.operators import resolution as R
from attestor.sources import tables as T

FACT = "fact_id string, doc_id string, page_no int, entity_id string, attribute_family string, attribute_raw string, value_raw string, unit string, value_num double, value_text string, currency string, period_start date, period_end date, period_raw string, as_of_date date, as_of_raw string, scope_raw string, scope_tags array<string>, confidence double, grounded boolean"
NAMES = [c.split()[0] for c in FACT.split(", ")]
D = dt.date


def facts(spark, *rows):
    base = {"doc_id": "d", "page_no": 1, "entity_id": "e", "attribute_family": "f", "attribute_raw": "attr", "scope_tags": [], "confidence": 0.9, "grounded": True}
    full = [base | {"fact_id": f"f{i}", "doc_id": f"d{i % 2}"} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(n) for n in NAMES) for r in full], FACT)


def num(v, raw=None, **more):
    return {"value_num": float(v), "value_raw": raw or f"{v}"} | more


CASES = [
    ("R1", num(5, currency="INR"), num(5, currency="USD")), ("R2", num(5), {"value_text": "five", "value_raw": "five"}),
    ("R3", num(58.13, unit="Percent"), num(7)), ("R4", num(1, period_start=D(2020, 1, 1), period_end=D(2020, 12, 31)), num(2, period_start=D(2021, 1, 1), period_end=D(2020, 12, 31))),
    ("R5", {"value_text": "appointed", "value_raw": "x", "as_of_date": D(2022, 1, 1)}, {"value_text": "resigned", "value_raw": "y", "as_of_date": D(2024, 1, 1)}),
    ("R6", num(1, period_end=D(2019, 3, 31), period_start=D(2018, 4, 1)), num(2, as_of_date=D(2024, 3, 31))),
    ("R7", num(1, scope_tags=["a", "b"], scope_raw="s"), num(2, scope_tags=["b", "c"], scope_raw="t")),
    ("R8", {"value_text": " Yes", "value_raw": "a"}, {"value_text": "yes", "value_raw": "b"}), ("R9", {"value_text": "x", "value_raw": "a"}, {"value_text": "y", "value_raw": "b"}),
    ("R10", num(59707490000.0), num(59710000000.0)), ("R11", num(1240), num(1240000)), ("R12", num(33200, ">33,200"), num(36000)),
    ("R14", num(100, confidence=0.5), num(150, confidence=0.5)), ("R15", num(100, confidence=0.5), num(150, confidence=0.0)), ("R15", num(0), num(150)),
]


@pytest.mark.parametrize("leaf,a,b", CASES)
def test_leaf(spark, leaf, a, b):
    row = A.adjudicated(facts(spark, a, b)).collect()
    assert [r.leaf for r in row] == [leaf] and row[0].explanation


def test_relations_of_lost_facts_stay_candidates(spark):
    before = facts(spark, num(100), num(150), num(100.2), num(170))
    candidates = P.candidates(before).select("relation_id", "fact_a", "fact_b")
    assert candidates.count() == 6
    gone = before.where("fact_id <> 'f3'").withColumn("grounded", F.col("fact_id") != "f0")
    got = {r.relation_id: r for r in A.adjudicated(gone, candidates=candidates).collect()}
    assert len(got) == 6
    assert {k for k, r in got.items() if (r.leaf, r.verdict, r.method, r.explanation) == ("R19", "candidate", "blocking", None)} == {k for k in got if "f0" in k or "f3" in k}
    assert got["rel_f1__f2"].leaf == "R15"
    assert {r.relation_id: r.verdict for r in A.settled(A.adjudicated(gone, candidates=candidates)).collect()} == {k: r.verdict for k, r in got.items()}


def test_a_bridge_that_is_lost_proves_nothing(spark):
    a, b = num(8703000000.0), num(8863030000.0)
    bridge = num(160030000.0, attribute_family="g", attribute_raw="acquired", value_raw="160.03m")
    before = facts(spark, a, b, bridge)
    candidates = P.candidates(before).select("relation_id", "fact_a", "fact_b")
    assert [r.leaf for r in A.adjudicated(before, candidates=candidates).collect()] == ["R13"]
    assert [r.leaf for r in A.adjudicated(before.withColumn("grounded", F.col("fact_id") != "f2"), candidates=candidates).collect()] == ["R15"]


def test_bridge_must_be_the_only_one(spark):
    a, b = num(8703000000.0), num(8863030000.0)
    bridge = num(160030000.0, attribute_family="g", attribute_raw="acquired", value_raw="160.03m")
    got = A.adjudicated(facts(spark, a, b, bridge)).where("fact_a = 'f0'").first()
    assert (got.leaf, got.method, got.bridging_fact_id) == ("R13", "derivation", "f2")
    assert got.explanation.startswith("8,703,000,000 + 160,030,000 = 8,863,030,000")
    assert A.adjudicated(facts(spark, a, b, bridge, bridge | {"attribute_family": "h"})).where("fact_b = 'f1'").first().leaf == "R15"
    assert A.adjudicated(facts(spark, num(164), num(160), num(4, attribute_family="g"))).where("fact_b = 'f1'").first().leaf == "R15"
    assert A.adjudicated(facts(spark, num(1000), num(30), num(970, attribute_family="g"))).where("fact_b = 'f1'").first().leaf == "R15"


def test_residual(spark):
    texts = [{"value_text": f"t{i}", "value_raw": "r", "doc_id": "d", "page_no": i} for i in range(7)]
    found = A.adjudicated(facts(spark, *texts))
    answers = spark.createDataFrame([("rel_f0__f1", "contradicts", "model"), ("rel_f0__f2", "nonsense", "model")], "relation_id string, verdict string, explanation string")
    got = {r.relation_id: (r.verdict, r.method) for r in A.settled(found, answers).collect()}
    assert len(got) == 21 and got["rel_f0__f1"] == ("contradicts", "llm") and got["rel_f0__f2"] == ("unrelated", "rule")
    assert sum(v[0] == "undecided" for v in got.values()) == 6


def test_pairs_cap_and_duplicates(spark):
    many = facts(spark, *[num(i, doc_id="d", page_no=i) for i in range(125)])
    assert P.pairs(many).count() == 120 * 119 // 2
    twice = facts(spark, num(5, doc_id="d"), num(5, doc_id="d"), num(5, doc_id="d", page_no=2))
    assert sorted(r.relation_id for r in P.candidates(twice).collect()) == ["rel_f0__f2", "rel_f1__f2"]


def test_all_pairs_of_large_buckets(spark, monkeypatch):
    """Without a cap, or with one beyond a block, each pair of a bucket is there once, in however many blocks the bucket lies."""
    monkeypatch.setattr(P, "BLOCK", 4)
    df = facts(spark, *(num(i, attribute_family="g" if i % 10 == 3 else "h" if i % 10 == 4 else "f") for i in range(40)), num(99, attribute_family="alone"))
    bucket = [[i for i in range(40) if i % 10 == d] for d in (3, 4)] + [[i for i in range(40) if i % 10 not in (3, 4)]]
    want = sorted("rel_" + "__".join(sorted((f"f{x}", f"f{y}"))) for b in bucket for n, x in enumerate(b) for y in b[:n])
    assert sorted(r.relation_id for r in P.pairs(df, None).select("relation_id").collect()) == want
    assert sorted(r.relation_id for r in P.candidates(df, 500).select("relation_id").collect()) == want
    assert P.candidates(df, 20).count() == 20 * 19 / 2 + 2 * 6
    cells = P.in_cells(df, 4).groupBy(*P.KEYS, "low", "high").count()
    assert cells.agg(F.max("count")).first()[0] < 32 > len(bucket[2]) - 1 and cells.count() > 20


def test_counted_pairs_keep_no_names(spark, monkeypatch):
    """Pairs that are only counted are stored without names and joined to no facts; open gaps and named leaves keep theirs, and leaves stay the same."""
    df = facts(spark, num(1000), num(400), num(600), num(1001), {"value_text": "x"}, {"value_text": "y"}, num(50, entity_id="e2"), num(5, entity_id="e2"))
    whole = {(r.fact_a, r.fact_b): r for r in A.verdicts(df, None).collect()}
    monkeypatch.setattr(A, "with_facts", None)
    got = A.verdicts(df.select(*A.JUDGED), None, named=("R9",)).collect()
    assert sorted(r.leaf for r in got) == sorted(r.leaf for r in whole.values())
    named = [r for r in got if r.relation_id]
    assert all(whole[r.fact_a, r.fact_b] == r for r in named) and {r.leaf for r in named} >= {"R9", "R13"} and {r.leaf for r in named} <= {"R9", "R13", "R14", "R15"}
    assert {r.leaf for r in got if not r.relation_id} >= {"R2", "R10"}


def test_grounding(spark):
    chunk = "Total assets | 88,140 | 91,502\nBad debt written\n off | 0.02 😀 tail"
    rows = [("a", "Total assets | 88,140", "88140"), ("b", " Bad debt written off", "1"), ("c", "elsewhere only", "only"), ("d", "5", "5"), ("e", "Bad debt\n0.02", "0.02"), ("f", r"\E|x", None), ("g", "😀 tail", ""), ("h", None, "x")]
    claims = spark.createDataFrame([(*r, chunk, 100, "page: elsewhere\tonly", 1) for r in rows], "fact_id string, evidence_text string, value_raw string, chunk_text string, chunk_char_start int, page_text string, page_no int")
    got = {r.fact_id: r for r in G.grounded(claims).collect()}
    assert (got["a"].grounding_method, got["a"].char_start, got["a"].value_in_evidence) == ("exact", 100, True)
    assert got["b"].grounding_method == "flexible" and chunk[got["b"].char_start - 100 : got["b"].char_end - 100] == "Bad debt written\n off"
    assert (got["c"].grounding_method, got["c"].char_start) == ("same_page", 6)
    assert not any(got[x].grounded for x in "defh") and got["d"].why_rejected.startswith("evidence too short")
    assert chunk[got["g"].char_start - 100 : got["g"].char_end - 100] == "😀 tail"


def test_names(spark):
    df = spark.createDataFrame([("Delhi Works Limited",), ("Delhi Works Ltd.",), ("Group",), ("Café & Co",), (None,)], "n string")
    got = [tuple(r) for r in df.select(R.simple_name(F.col("n")), R.is_self_reference(F.col("n"))).collect()]
    assert got == [("delhi works", False), ("delhi works", False), ("group", True), ("café", False), ("", False)]


def test_families_keep_signatures_apart(spark):
    rows = [(f"f{i:02d}", a) for i, a in enumerate(["revenue from contracts with customers"] * 3 + ["revenue from contracts with customers CAGR"] * 3 + ["revenue from contract with customers"])]
    got = {r.phrase: r.leader for r in R.family_leaders(spark.createDataFrame(rows, "fact_id string, attribute_raw string")).collect()}
    assert got["revenue from contract with customers"] == "revenue from contracts with customers"
    assert got["revenue from contracts with customers cagr"] == "revenue from contracts with customers cagr"


def leaders_by_hand(phrases, least, count):
    leaders, out = [], {}
    for phrase, n, _ in sorted(phrases, key=lambda p: (-p[1], p[2])):
        tidy = " ".join(sorted(phrase.split()))
        scored = [(score(tidy, " ".join(sorted(x.split()))), -i, x) for i, x in enumerate(leaders)]
        best = max((s for s in scored if s[0] >= least), default=None)
        if best is None and n >= count:
            leaders.append(phrase)
        out[phrase] = best[2] if best else phrase
    return out, set(leaders)


@pytest.mark.parametrize("least,count", [(93.0, 1), (88.0, 2), (70.0, 1)])
def test_clusters(spark, least, count):
    rng = random.Random(int(least))
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(0, 30))).strip() for _ in range(60)]
    phrases = set(base)
    for _ in range(150):
        t = list(rng.choice(base))
        for _ in range(rng.randint(1, 3)):
            t.insert(rng.randrange(len(t) + 1), rng.choice("abcde")) if rng.random() < 0.5 or not t else t.pop(rng.randrange(len(t)))
        phrases.add(" ".join("".join(t).split()))
    rows = [(p, rng.randint(1, 4), f"f{i:04d}") for i, p in enumerate(sorted(phrases))]
    want, leads = leaders_by_hand(rows, least, count)
    got = R.clusters(spark.createDataFrame(rows, "phrase string, n long, first string"), least, count).collect()
    assert {r.phrase: r.leader for r in got} == want and {r.phrase for r in got if r.leads} == leads


@settings(max_examples=200, deadline=None)
@given(st.text("abc d", max_size=12), st.text("abc d", max_size=12))
def test_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert lcs_length(a, b) == table[-1][-1] and 0 <= score(a, b) <= 100


def test_answers(spark):
    rows = [("r1", "d", '{"facts": []}'), ("r2", "d", "[]"), ("r3", "d", "oops"), ("r4", "d", None), ("r5", "d", '[{"chunk_id":"c","attribute":" a ","value_raw":"1","value_kind":"number","source_kind":"prose","evidence":"e","unit":"N/A"},{"chunk_id":"c"}]')]
    got = E.parsed(spark.createDataFrame(rows, "request_id string, doc_id string, answer string")).orderBy("request_id", "position").collect()
    assert [(r.request_id, r.complaint) for r in got] == [("r3", "answer is not JSON"), ("r4", "answer is not JSON"), ("r5", None), ("r5", "attribute is missing")]
    assert got[2].attribute == "a" and got[2].unit is None


def test_retries():
    waits, calls = [], []

    def provider(_):
        calls.append(1)
        raise RuntimeError("503" if len(calls) < 4 else "broken")

    with pytest.raises(RuntimeError, match="broken"):
        E.with_retries(provider, sleep=waits.append)("p")
    assert waits == [2.0, 4.0, 8.0]


def test_stored_tables(spark, tmp_path):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "doc_id string, v int")
    a.write.partitionBy("doc_id").parquet(f"{tmp_path}/t")
    T.replace_documents(spark.createDataFrame([("y", 3), ("y", 4)], "doc_id string, v int"), f"{tmp_path}/t")
    assert sorted((r.doc_id, r.v) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [("x", 1), ("y", 3), ("y", 4)]
    a.write.parquet(f"{tmp_path}/u")
    T.append(spark.createDataFrame([("y", 9), ("z", 5), ("z", 6)], "doc_id string, v int"), f"{tmp_path}/u", ["doc_id"])
    assert sorted((r.doc_id, r.v) for r in spark.read.parquet(f"{tmp_path}/u").collect()) == [("x", 1), ("y", 2), ("z", 5)]
    with pytest.raises(ValueError):
        T.check_columns(a, ["doc_id"])


def test_upload_stream(spark, tmp_path):
    from attestor.sources.files import scanned
    from attestor.streaming.uploads import process_uploads, upload_stream

    folder = tmp_path / "in"
    folder.mkdir()
    for name, data in (("My Report.pdf", b"one"), ("copy.pdf", b"one"), ("b.pdf", b"two"), ("n.txt", b"x")):
        (folder / name).write_bytes(data)
    assert scanned(spark, str(folder)).count() == 3
    seen = []
    for _ in range(2):
        process_uploads(upload_stream(spark, str(folder), "*.pdf"), lambda b: seen.extend(r.sha256 for r in b.collect()), f"{tmp_path}/ck").awaitTermination()
    assert len(seen) == 2 and len(set(seen)) == 2
