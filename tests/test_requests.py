"""Requests to a model and their answers, files through a decoder, catalog, samples and stored pages."""

import json

from pyspark.sql import functions as F

from attestor.operators import adjudication, layout, reads, resolution
from attestor.plans import prompts
from attestor.plans.pipeline import Run
from attestor.plans.settings import Settings
from attestor.sources import files, tables
from tests.test_facts import facts


def text(value, **more):
    return {"value_num": None, "value_text": value, "value_raw": value, "confidence": 0.9} | more


def test_pairs_that_no_rule_settles(spark):
    found = adjudication.adjudicated(facts(spark, *(text(f"state {i}") for i in range(3))).withColumns({"subject_raw": F.lit("Works"), "evidence_text": F.col("value_raw")}))
    asked = prompts.adjudication_prompts(found, 2).orderBy("request_id").collect()
    first = found.where("verdict = 'needs_a_judgement'").orderBy(F.col("a.doc_id") == F.col("b.doc_id"), "relation_id").limit(2).collect()
    assert sorted(r.request_id for r in asked) == sorted(r.relation_id for r in first) and len(asked) == 2
    assert all(p.prompt.startswith(prompts.ADJUDICATION) and p.prompt.count("value: state") == 2 and "scope: not stated" in p.prompt for p in asked)
    said = [(asked[0].request_id, '{"verdict": " Superseded ", "explanation": "it changed"}'), (asked[1].request_id, '{"verdict": "maybe", "explanation": ""}')]
    got = prompts.adjudication_answers(spark.createDataFrame([*said, ("x", "not JSON")], "request_id string, answer string"))
    assert [tuple(r) for r in got.collect()] == [(asked[0].request_id, "superseded", "it changed")]
    settled = {r.relation_id: (r.verdict, r.method) for r in adjudication.settled(found, got, 2).collect()}
    assert settled[asked[0].request_id] == ("superseded", "llm") and settled[asked[1].request_id] == ("unrelated", "rule")


def test_merging_labels(spark):
    sizes = spark.createDataFrame([("team size", 5), ("headcount", 9), ("rare", 1), ("margin", 3)], "label string, n_facts long")
    row = prompts.merge_prompt(sizes).first()
    assert row.prompt.startswith(prompts.MERGE) and row.prompt.endswith("- headcount\n- margin\n- team size")
    assert prompts.merge_prompt(sizes.where("n_facts > 5")).isEmpty()
    answer = json.dumps([{"canonical": "staff", "members": ["team size", "headcount", "invented"]}, {"canonical": "margin", "members": ["margin"]}])
    groups = prompts.merge_groups(spark.createDataFrame([(answer,), (None,), ("no",)], "answer string"))
    assert {r.label: r.final_label for r in resolution.semantic_merge(sizes, groups).collect()} == {"team size": "headcount", "headcount": "headcount", "rare": "rare", "margin": "margin"}


def provider(prompt: str) -> str:
    if prompt.startswith(prompts.MERGE):
        raise ValueError("no such model")
    if prompt.startswith(prompts.ADJUDICATION):
        return '{"verdict": "reconciled", "explanation": "two plants"}'
    chunk_id = prompt.split("=== PASSAGE ")[-1].split(" ===")[0]
    claim = {"chunk_id": chunk_id, "subject": "Works", "value_kind": "text", "source_kind": "prose"}
    words = [w for w in ("closed", "open", "sold") if w in prompt.split("=== PASSAGE ")[-1]]
    out = [claim | {"attribute": a, "value_raw": w, "evidence": w} for w in words for a in ("state", "condition of roof")]
    return json.dumps({"facts": [*out, claim | {"chunk_id": "nowhere", "attribute": "state", "value_raw": "x", "evidence": "x"}, claim]})


def document(words):
    box = {"page_no": 1, "left": 50.0, "right": 500.0, "font_size": 10.0, "page_width": 612.0, "page_height": 792.0}
    return {"lines": [box | {"line_id": f"l{i}", "text": f"In 2020 the Works were {w} by decision of the Board of Trade\x01", "top": 100.0 + 12 * i, "bottom": 110.0 + 12 * i} for i, w in enumerate(words)], "tables": []}


def test_files_to_verdicts_with_their_failures(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/One.pdf").write_text(json.dumps(document(["closed", "open"])))
    (tmp_path / "in/two.pdf").write_text(json.dumps(document(["sold", "closed"])))
    (tmp_path / "in/broken.pdf").write_text("not a document")
    run = Run(spark, f"file://{tmp_path}/run", provider, Settings(requests_per_minute=1e6, requests_per_round=1))
    run.ingest_files(f"file://{tmp_path}/in", json.loads)
    assert run.read("pages").count() == 2 and run.read("pages").where("raw_text LIKE '%\x01%'").isEmpty()
    run.cut()
    run.extract()
    assert run.read("answers").count() == 2
    run.ground()
    run.normalise()
    run.pair()
    got = run.adjudicate()
    assert {r.verdict for r in got.where("method = 'llm'").collect()} == {"reconciled"}
    lost = {(r.stage, r.kind) for r in run.failures().collect()}
    assert lost == {("decode", "file_not_decoded"), ("extract", "invalid_claim"), ("extract", "passage_not_in_request"), ("normalise", "family_merge_failed")}
    assert run.failures().where("stage = 'decode'").first().subject.startswith("doc_broken_")


def test_bucket_cap_is_used(spark, tmp_path):
    run = Run(spark, f"file://{tmp_path}", settings=Settings(bucket_cap=2))
    run.write(facts(spark, *(text(f"state {i}") for i in range(5))), "facts")
    assert run.pair().count() == 1


def test_catalog_samples_and_stored_pages(spark, tmp_path):
    folder = f"file://{tmp_path}"
    spark.range(10).write.parquet(f"{folder}/facts")
    spark.range(4).withColumn("doc_id", F.lit("d")).write.partitionBy("doc_id").parquet(f"{folder}/pages")
    assert {r.name for r in tables.catalog(spark, folder).collect()} == {"facts", "pages"}
    assert tables.missing_tables(spark, folder, ["facts", "chunks"]) == ["chunks"]
    pick = lambda seed: [r.id for r in tables.sampled(spark.range(1000), 5, "id", seed).collect()]
    assert pick(1) == pick(1) != pick(2) and len(set(pick(1))) == 5
    documents = spark.createDataFrame([("doc_a", "Alpha.pdf"), ("doc_b", "Alpine.pdf")], "doc_id string, filename string")
    pages = spark.createDataFrame([("doc_a", 1, "text", {"1": "n"}), ("doc_b", 1, "other", {})], "doc_id string, page_no int, raw_text string, footnotes map<string,string>")
    assert [r.raw_text for r in reads.stored_page(documents, pages, "alpha", 1).collect()] == ["text"]
    assert sorted((r.filename, r.raw_text) for r in reads.stored_page(documents, pages, "alp", 1).collect()) == [("Alpha.pdf", None), ("Alpine.pdf", None)]
    assert reads.stored_page(documents, pages, "x", 1).isEmpty()


def test_files_are_decoded_one_by_one(spark, tmp_path):
    (tmp_path / "a.pdf").write_text(json.dumps(document(["open"])))
    (tmp_path / "b.pdf").write_bytes(b"\xff")
    rows = {r.doc_id[:5]: r for r in files.decoded(spark, f"file://{tmp_path}", json.loads).collect()}
    assert rows["doc_a"].error is None and len(rows["doc_a"].lines) == 1 and rows["doc_b"].lines is None and "Error" in rows["doc_b"].error


def test_a_page_that_fails_does_not_lose_the_others(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_text(json.dumps(["open", None, "sold", 7, "closed"]))
    (tmp_path / "in/b.pdf").write_text("{")

    def pages(content):
        def page(word):
            if word is None:
                raise KeyError("font")
            return {"lines": [{k: v for k, v in x.items() if k != "page_no"} | {"top": "high" if word == 7 else x["top"]} for x in document([word])["lines"]]}

        return [lambda w=w: page(w) for w in json.loads(content)]

    run = Run(spark, f"file://{tmp_path}/run", settings=Settings(max_pages=4))
    run.ingest_files(f"file://{tmp_path}/in", pages)
    assert sorted(r.page_no for r in run.read("pages").collect()) == [1, 3]
    lost = sorted((r.kind, r.subject.split("_")[1] + r.subject[-7:], r.detail.split(":")[0]) for r in run.failures().where("stage = 'decode'").collect())
    assert [(k, s[0], s[-6:] if k.startswith("page") else "", e) for k, s, e in lost] == [("file_not_decoded", "b", "", "JSONDecodeError"), ("page_not_decoded", "a", "page 2", "KeyError"), ("page_not_decoded", "a", "page 4", lost[2][2])]
    assert {r.doc_id[:5]: r.pages for r in run.read("decoded").collect()} == {"doc_a": 5, "doc_b": None}


def test_document_summary(spark):
    pages = [("d", 1, "x" * 150), ("d", 2, "short"), ("d", 10, f"{layout.TABLES_MARK}\nTABLE 1\na | b\n\n{layout.FOOTNOTES_MARK}\n(1) n"), ("e", 3, "y" * 100), ("e", 1, "")]
    got = {r.doc_id: tuple(r)[1:] for r in layout.document_summary(spark.createDataFrame(pages, "doc_id string, page_no int, raw_text string")).collect()}
    assert got == {"d": (3, 155 + len(pages[2][2]), 1, 1, "2,10"), "e": (2, 100, 0, 0, "1")}
