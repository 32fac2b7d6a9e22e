"""Model calls at a common rate, table functions, schemas, scripts, uploads, and similarity in batches."""

import json
import random
import time
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from attestor.functions import similarity
from attestor.operators import model_calls as M
from attestor.plans import prompts
from attestor.plans.pipeline import Run
from attestor.plans.settings import Settings
from attestor.sources import tables
from attestor.streaming.uploads import process_uploads, upload_stream

PROMPT = "request_id string, doc_id string, prompt string"


def test_plan_shares_slots_an_interval_apart():
    free, slots = M.plan(100.0, 0.0, [(0.0, 3), (None, 0), (0.0, 1), (101.0, 5)], 0.5, 2)
    assert slots == [[100.0, 101.0], [], [100.5], []] and free == 101.5
    assert M.plan(100.0, 104.0, [(0.0, 1)], 1.0, 9) == (105.0, [[104.0]])
    assert M.plan(100.0, 7.0, [(101.0, 1), (None, 0)], 1.0, 9) == (7.0, [[], []])


def test_uneven_tasks_and_failures_keep_a_common_rate(spark, tmp_path):
    log = str(tmp_path)

    def provider(prompt):
        import os
        import time as t
        import uuid

        at = t.time()
        with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
            f.write(f"{at} {prompt}")
        seen = sum(open(f"{log}/{x}").read().endswith(f" {prompt}") for x in os.listdir(log))
        if prompt.startswith("late") and seen < 3:
            raise RuntimeError("503 unavailable")
        if prompt.startswith("bad"):
            raise ValueError("no")
        return None if prompt.startswith("none") else f"answer to {prompt}"

    kinds = ["late", "bad", "none"] + ["good"] * 17
    rows = [(f"r{i}", "d", f"{kinds[i % 20]} {i}") for i in range(40)]
    per_minute = 600.0
    start = time.time()
    got = M.paced(spark.createDataFrame(rows, PROMPT), provider, per_minute, 3, wait=0.5).collect()
    assert len(got) == 40 and all((r.answer is None) != (r.error is None) for r in got)
    by = defaultdict(set)
    for r in got:
        by[kinds[int(r.request_id[1:]) % 20]].add((r.answer and r.answer.split(" to ")[0], r.error))
    assert by == {"late": {("answer", None)}, "bad": {(None, "no")}, "none": {(None, M.NO_ANSWER)}, "good": {("answer", None)}}
    times = sorted(float(f.read_text().split(" ")[0]) for f in tmp_path.iterdir())
    assert len(times) == 40 + 2 * 2  # two prompts came through at the third try
    for i, t in enumerate(times):  # in any second the rate's calls and those of one round at most
        assert sum(t <= u < t + 1 for u in times[i:]) <= 2 * per_minute / 60 + 1
    assert (len(times) - 1) / (times[-1] - times[0]) <= per_minute / 60 * 1.1 and time.time() - start < 60


def test_every_request_is_answered_or_failed(spark):
    made = M.paced(spark.createDataFrame([(f"r{i}", None, None if i == 3 else str(i)) for i in range(700)], PROMPT), lambda p: p, 1e6, 2).collect()
    assert len(made) == 700 and {r.request_id for r in made if r.error} == {"r3"}
    assert M.paced(spark.createDataFrame([], PROMPT), lambda p: p, 1e6, 2).count() == 0


KIND = StructType([StructField("name", StringType(), False), StructField("n", LongType()), StructField("share", DoubleType()), StructField("ok", BooleanType()), StructField("parts", ArrayType(StructType([StructField("id", StringType(), False)])))])


@pytest.mark.parametrize(
    "answer, problem",
    [
        ('{"name": "x"}', None), ('{"name": "x", "n": 1, "share": 2, "ok": true, "parts": [{"id": "a", "more": 1}], "else": 0}', None), ('{"n": 1}', "answer.name is missing"), ('{"name": null}', "answer.name is missing"),
        ('{"name": 1}', "answer.name is no string"), ('{"name": "x", "n": 1.5}', "answer.n is no integer"), ('{"name": "x", "n": true}', "answer.n is no integer"), ('{"name": "x", "ok": 1}', "answer.ok is no boolean"),
        ('{"name": "x", "parts": [{"id": "a"}, {}]}', "answer.parts[1].id is missing"), ('{"name": "x", "parts": {}}', "answer.parts is no array"), ('{"name": "x", "parts": [null]}', "answer.parts[0] is missing"), ("[]", "answer is no object"),
    ],
)
def test_answers_are_held_against_their_type(answer, problem):
    assert M.mismatch(json.loads(answer), KIND) == problem


def test_schemas_for_providers():
    assert M.json_schema(prompts.VERDICT_ANSWER) == {"type": "object", "properties": {"verdict": {"type": "string"}, "explanation": {"type": "string"}}, "required": ["verdict", "explanation"]}
    claims = M.json_schema(prompts.CLAIMS_ANSWER)["properties"]["facts"]["items"]
    assert claims["required"] == ["chunk_id", "attribute", "value_raw", "value_kind", "source_kind", "evidence"] and claims["properties"]["unit"] == {"type": "string", "nullable": True}
    assert M.json_schema(prompts.MERGE_ANSWER)["items"]["required"] == ["canonical", "members"]


def test_table_function_in_sql(spark):
    def provider(prompt, schema):
        if prompt == "fail":
            raise RuntimeError("down")
        return {"none": None, "odd": "{", "short": '{"verdict": "x"}'}.get(prompt, json.dumps({"verdict": ",".join(schema["required"]), "explanation": prompt}))

    spark.udtf.register("ask_model", M.ask_model(provider, prompts.VERDICT_ANSWER))
    rows = spark.createDataFrame([("a", "p"), ("b", "none"), ("c", "fail"), ("d", "short"), ("e", None), ("f", "odd")], "request_id string, prompt string")
    got = {r.request_id: (r.answer, r.error) for r in spark.sql("SELECT a.* FROM {rows}, LATERAL ask_model(request_id, prompt) a", rows=rows).collect()}
    assert json.loads(got["a"][0]) == {"verdict": "verdict,explanation", "explanation": "p"} and got["a"][1] is None
    assert got["b"] == (None, M.NO_ANSWER) and got["c"] == (None, "RuntimeError: down") and got["d"] == (None, "answer.explanation is missing") and got["e"] == (None, "there is no prompt")
    assert got["f"][0] is None and got["f"][1].startswith("JSONDecodeError")


def test_equal_prompts_are_asked_once_and_none_is_a_failure(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    log = str(tmp_path / "calls")

    def provider(prompt):
        import uuid

        open(f"{log}/{uuid.uuid4().hex}", "w").write(prompt)
        return None if prompt == "none" else prompt.upper()

    run = Run(spark, f"file://{tmp_path}/run", provider, Settings(requests_per_minute=1e6, requests_per_round=2))
    ask = spark.createDataFrame([("a", "d", "x"), ("b", "d", "x"), ("c", "d", "none"), ("e", "d", "none"), ("f", "d", "y")], PROMPT)
    want = [("a", "X", None), ("b", "X", None), ("c", None, M.NO_ANSWER), ("e", None, M.NO_ANSWER), ("f", "Y", None)]
    assert sorted((r.request_id, r.answer, r.error) for r in run.ask(ask).collect()) == want
    assert sorted(f.read_text() for f in (tmp_path / "calls").iterdir()) == ["none", "x", "y"]
    assert sorted((r.request_id, r.answer, r.error) for r in run.ask(ask).collect()) == want
    assert sorted(f.read_text() for f in (tmp_path / "calls").iterdir()) == ["none", "none", "x", "y"]


def test_scripts(spark):
    script = """-- a; comment 'with quotes
    CREATE OR REPLACE TEMP VIEW v AS SELECT 'a;b' AS x, "c;""d" AS y, 'it\\'s;' AS z; /* ; */
    CREATE OR REPLACE TEMP VIEW w AS SELECT 6 - -3 / 3 AS `n;m`;;
    """
    assert len(tables.statements(script)) == 2
    tables.run_script(spark, script)
    assert tuple(spark.table("v").first())[0] == "a;b" and spark.table("v").first().z == "it's;"
    assert spark.table("w").columns == ["n;m"] and tables.statements("SELECT 1 -- end") == ["SELECT 1"] and tables.statements(" ; ;") == []
    assert tables.statements("SELECT 'open; ") == ["SELECT 'open;"]


def test_uploads_keep_no_fingerprints_in_state(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen = []

    def go(known=None, name="ck"):
        before = len(seen)
        process_uploads(upload_stream(spark, str(tmp_path / "in")), lambda b: seen.extend((r.filename, r.sha256, bytes(r.content)) for r in b.collect()), f"{tmp_path}/{name}", known).awaitTermination()
        return [(f, c) for f, _, c in seen[before:]]

    (tmp_path / "in/a.pdf").write_bytes(b"one")
    (tmp_path / "in/b.pdf").write_bytes(b"one")
    assert go() == [("a.pdf", b"one")]
    (tmp_path / "in/c.pdf").write_bytes(b"one")
    (tmp_path / "in/d.pdf").write_bytes(b"two")
    assert go() == [("d.pdf", b"two")] and go() == []
    documents = spark.createDataFrame([(seen[0][1],)], "sha256 string")
    assert go(lambda: documents, "other") == [("d.pdf", b"two")]


def test_similarity_of_batches():
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abé😀 ") for _ in range(rng.randint(0, n)))
    pairs = [(word(n), word(n)) for n in (3, 20, 64, 65, 130, 250) for _ in range(60)]
    assert similarity.lcs_lengths([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [similarity.lcs_length(a, b) for a, b in pairs]
    pairs += [("", ""), ("a", ""), ("x" * 64, "x" * 64), ("x" * 256, "x" * 256), ("y" * 3000, "xy" * 2000), ("a\0b", "a b"), (None, "a"), ("a", None)]
    tidy = lambda x: " ".join(sorted(x.split()))
    want = [None if None in p else similarity.score(tidy(p[0]), tidy(p[1])) for p in pairs]
    assert similarity.token_sort_ratio(pd.Series([a for a, _ in pairs]), pd.Series([b for _, b in pairs])).tolist() == want


def test_similarity_is_quicker_in_batches_and_known_to_sql(spark):
    rng = random.Random(7)
    names = [" ".join(rng.choice(["net", "revenue", "from", "parts", "operations", "total", "segment"]) for _ in range(4)) + f" {i}" for i in range(20_000)]
    a, b = names, names[1:] + names[:1]
    start = time.time()
    got = similarity.token_sort_ratio(pd.Series(a), pd.Series(b))
    batch = time.time() - start
    tidy = lambda x: " ".join(sorted(x.split()))
    start = time.time()
    assert got.tolist() == [similarity.score(tidy(x), tidy(y)) for x, y in zip(a, b, strict=True)]
    assert batch < time.time() - start
    similarity.register(spark)
    assert spark.sql("SELECT token_sort_ratio('b a', 'a b') AS s, token_sort_ratio(NULL, 'a') AS n").first() == (100.0, None)
    assert spark.range(1).select(F.expr("token_sort_ratio('abc', 'abd')").alias("s")).first().s == pytest.approx(66.6667, abs=1e-3)
