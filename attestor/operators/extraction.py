"""Requests to a model, its answers, and the claims that they hold. The model itself is a callable that is passed in."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.arrays import chain, runs
from attestor.functions.parsing import bound
from attestor.functions.text import trimmed, word_count

# Fixed values.
REQUEST_WORDS = 1200
REQUEST_PASSAGES = 4
TRUNCATED = 100_000
VALUE_KINDS = ("number", "date", "text")
SOURCE_KINDS = ("prose", "table_row", "footnote", "heading", "figure_label")
KNOWN_KINDS = {"table": "table_row", "footnotes": "footnote"}
CONFIDENCE = {"prose": 0.90, "footnote": 0.85, "table_row": 0.75, "heading": 0.60, "figure_label": 0.50}
UNKNOWN_CONFIDENCE = 0.50
MISSING = ("", "null", "none", "n/a", "na", "not stated", "unknown")
RETRY_SIGNS = ("429", "resource_exhausted", "resource exhausted", "quota", "rate limit", "too many requests", "503", "500", "unavailable", "internal error", "deadline", "timeout")
ATTEMPTS = 5
FIRST_WAIT = 2.0
CLAIM = "chunk_id string, subject string, attribute string, value_raw string, value_kind string, unit string, currency string, period_text string, as_of_text string, scope string, source_kind string, evidence string"
REQUIRED = ("chunk_id", "attribute", "value_raw", "evidence")


def packed(chunk: DataFrame) -> DataFrame:
    """request_id, doc_id, chunk_ids of passages worth a call: in order of chunk_id, up to 1,200 words and four passages; one alone is always let in."""
    item = F.struct("chunk_id", word_count(F.col("text")).alias("words"))
    listed = chunk.where("was_sent_to_llm").groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def after(items: Column, i: Column) -> Column:
        """The place of the first passage that a request from place i doesn't hold."""
        words, fits, count = F.get(items, i)["words"], F.lit(True), F.lit(1)
        for k in range(1, REQUEST_PASSAGES):
            words = words + F.get(items, i + k)["words"]
            fits = fits & F.coalesce(words <= REQUEST_WORDS, F.lit(False))
            count = count + fits.cast("int")
        return i + count

    starts = lambda items: chain(F.transform(items, lambda _, i: after(items, i)))
    ids = lambda items, r: F.transform(F.slice(items, r["start"] + 1, r["end"] - r["start"]), lambda p: p["chunk_id"])
    requests = bound(F.col("items"), lambda items: F.transform(bound(starts(items), lambda s: runs(s, F.size(items))), lambda r: ids(items, r)))
    rows = listed.select("doc_id", F.posexplode(requests).alias("n", "chunk_ids"))
    return rows.select(F.format_string("%s__r%04d", "doc_id", "n").alias("request_id"), "doc_id", "chunk_ids")


def prompts(requests: DataFrame, chunk: DataFrame, instructions: str) -> DataFrame:
    """request_id, doc_id, prompt: the instructions, then each passage under its header, in order of chunk_id."""
    members = requests.select("request_id", "doc_id", F.explode("chunk_ids").alias("chunk_id")).join(chunk.select("chunk_id", "context_header", "text"), "chunk_id")
    section = F.concat(F.lit("=== PASSAGE "), "chunk_id", F.lit(" ===\n"), F.when(F.col("context_header") != "", F.concat("context_header", F.lit("\n"))).otherwise(""), "text")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", section.alias("s")))), lambda x: x["s"]), "\n\n")
    return members.groupBy("request_id", "doc_id").agg(F.concat(F.lit(instructions + "\n\n"), body).alias("prompt"))


def cache_key(version: Column, model: Column, prompt: Column) -> Column:
    return F.sha2(F.concat_ws("\n---\n", version, model, prompt).cast("binary"), 256)


def cache_misses(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (with column key) that no cached answer (key, answer) serves."""
    return keyed.join(cache.select("key"), "key", "left_anti")


def is_transient(message: str) -> bool:
    """A failure that may pass if tried again."""
    low = message.lower()
    return any(s in low for s in RETRY_SIGNS)


def with_retries(provider: Callable[[str], str], attempts: int = ATTEMPTS, wait: float = FIRST_WAIT, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """provider with waits that double after each transient failure."""

    def ask(prompt: str) -> str:
        for n in range(attempts):
            try:
                return provider(prompt)
            except Exception as error:
                if n + 1 == attempts or not is_transient(str(error)):
                    raise
                sleep(wait * 2**n)
        raise AssertionError

    return ask


def missing_as_null(x: Column) -> Column:
    """Edges trimmed; the usual spellings of nothing are null."""
    tidy = trimmed(x)
    return F.when(F.lower(tidy).isin(*MISSING), None).otherwise(tidy)


def parsed(answer: DataFrame) -> DataFrame:
    """Claims of answers with request_id, doc_id, position, and complaint: why the claim is to be dropped, null if it is sound.

    An answer is an array of claims or an object with the array in "facts"; one that is neither gives a single row
    with a complaint.
    """
    kind = f"array<struct<{CLAIM.replace(' string', ':string').replace(', ', ',')}>>"
    body = trimmed(F.coalesce("answer", F.lit("")))
    found = F.when(body.startswith("["), F.from_json(body, kind)).otherwise(F.from_json(body, f"struct<facts:{kind}>")["facts"])
    broken = F.when(F.length(body) > TRUNCATED, "answer is not JSON, probably cut off").otherwise("answer is not JSON")
    rows = answer.withColumn("claims", found).select("request_id", "doc_id", F.when(F.col("claims").isNull(), broken).alias("broken"), F.posexplode_outer("claims").alias("position", "c"))
    rows = rows.where("broken IS NOT NULL OR c IS NOT NULL")
    edges = {n: F.nullif(trimmed(F.col(f"c.{n}")), F.lit("")) for n in ("chunk_id", "subject", "attribute", "value_raw", "value_kind", "source_kind", "evidence")}
    empty = {n: missing_as_null(F.col(f"c.{n}")) for n in ("unit", "currency", "period_text", "as_of_text", "scope")}
    rows = rows.select("request_id", "doc_id", "position", "broken", *(v.alias(k) for k, v in (edges | empty).items()))
    complaint = F.col("broken")
    for n in REQUIRED:
        complaint = F.coalesce(complaint, F.when(F.col(n).isNull(), f"{n} is missing"))
    for n, values in (("value_kind", VALUE_KINDS), ("source_kind", SOURCE_KINDS)):
        complaint = F.coalesce(complaint, F.when(F.coalesce(F.col(n).isin(*values), F.lit(False)), None).otherwise(f"{n} is not known"))
    return rows.withColumn("complaint", complaint).drop("broken")


def attributed(claims: DataFrame, requests: DataFrame, chunk: DataFrame) -> DataFrame:
    """Sound claims whose passage was in their request, as fact rows."""
    sent = requests.select("request_id", F.explode("chunk_ids").alias("chunk_id"))
    known = claims.where("complaint IS NULL").drop("doc_id").join(sent, ["request_id", "chunk_id"]).join(chunk.select("chunk_id", "doc_id", "page_no", F.col("kind").alias("chunk_kind")), "chunk_id")
    n = F.row_number().over(Window.partitionBy("request_id", "chunk_id").orderBy("position")) - 1
    own = F.create_map(*(F.lit(x) for kv in KNOWN_KINDS.items() for x in kv))
    trust = F.create_map(*(F.lit(x) for kv in CONFIDENCE.items() for x in kv))
    kind = F.coalesce(F.try_element_at(own, F.col("chunk_kind")), "source_kind")
    rows = known.withColumn("n", n).withColumn("source_kind", kind)
    return rows.select(
        F.format_string("%s__f%02d", "chunk_id", "n").alias("fact_id"), "chunk_id", "doc_id", "page_no", F.col("subject").alias("subject_raw"), F.col("attribute").alias("attribute_raw"), "value_raw", "value_kind",
        F.when(F.col("value_kind") != "number", F.col("value_raw")).alias("value_text"), "unit", "currency", F.col("period_text").alias("period_raw"), F.col("as_of_text").alias("as_of_raw"), F.col("scope").alias("scope_raw"),
        "source_kind", F.coalesce(F.try_element_at(trust, F.col("source_kind")), F.lit(UNKNOWN_CONFIDENCE)).alias("confidence"), F.col("evidence").alias("evidence_text"), F.lit(False).alias("grounded"),
    )


def misattributed(claims: DataFrame, requests: DataFrame) -> DataFrame:
    """Sound claims that name a passage which wasn't in their request."""
    sent = requests.select("request_id", F.explode("chunk_ids").alias("chunk_id"))
    return claims.where("complaint IS NULL").join(sent, ["request_id", "chunk_id"], "left_anti").select("request_id", "chunk_id", "position")


def fill_rates(facts: DataFrame) -> DataFrame:
    """Per source kind: facts, and those with period, as-of date, scope and subject."""
    some = lambda c: F.count_if(F.col(c).isNotNull())
    return facts.groupBy("source_kind").agg(F.count(F.lit(1)).alias("n"), some("period_raw").alias("with_period"), some("as_of_raw").alias("with_as_of"), some("scope_raw").alias("with_scope"), some("subject_raw").alias("with_subject"))
