"""All stages from lines to verdicts, with a provider that reads claims off the prompt."""

import json
import re

from attestor.plans.pipeline import Run
from attestor.plans.settings import Settings
from attestor.sources import adapters


def provider(prompt: str) -> str:
    claims = []
    for section in prompt.split("=== PASSAGE ")[1:]:
        chunk_id = section.split(" ===")[0]
        for m in list(re.finditer(r"line (\d+) of text", section))[:6]:
            kind = {"subject": f"Works {int(m[1]) % 4} Limited", "attribute": "net count", "value_kind": "number", "source_kind": "prose"}
            claims.append(kind | {"chunk_id": chunk_id, "value_raw": m[1], "evidence": m[0], "unit": "n/a"})
    return json.dumps({"facts": claims})


def test_run(spark, tmp_path):
    run = Run(spark, f"file://{tmp_path}", provider, Settings(requests_per_minute=1e6))
    lines = adapters.lines(spark, "/root/testdata/sf0.001").where("page_no < 4")
    relations = run.all(lines, adapters.raw_tables(spark, "/root/testdata/sf0.001").where("page_no < 4"))
    facts = run.read("facts")
    assert facts.where("NOT grounded").isEmpty() and facts.where("value_num IS NULL").isEmpty()
    assert relations.count() == run.read("candidates").count() > 0
    assert relations.where("verdict IS NULL OR explanation IS NULL").isEmpty()
    assert {r.canonical_name for r in run.read("entities").collect()} <= {f"Works {i} Limited" for i in range(4)}
    asked = run.read("cache").count()
    run.extract()  # all answers are cached now
    assert run.read("cache").count() == asked and run.read("answers").isEmpty()


def test_settings(spark):
    spark.conf.set("attestor.bucket_cap", "7")
    spark.conf.set("attestor.model_pairs", "many")
    got = Settings.of(spark, model="m")
    spark.conf.unset("attestor.bucket_cap")
    spark.conf.unset("attestor.model_pairs")
    assert (got.bucket_cap, got.model_pairs, got.model) == (7, 15, "m")
