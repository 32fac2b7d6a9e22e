"""What a model is asked, and how its answers are read: extraction, merging of family labels, and pairs that no rule settles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from attestor.functions.text import collapsed, shortened
from attestor.operators.adjudication import MODEL_VERDICTS, asked_first
from attestor.operators.resolution import offered_labels

EXTRACTION = """\
Read the passages below and list every claim they make. A claim gives a named thing a value, a state, a date or a relation. Passages that
make none, such as tables of contents, have an empty list.

Answer with JSON alone: {"facts": [...]}, one object for each claim, with these members.

chunk_id     identifier of the passage, as it stands in its heading
subject      what the claim is about, in the passage's words; null where the passage means the document's own subject without naming it
attribute    the property, in the passage's words, without the value
value_raw    the value as printed, with separators, signs and symbols
value_kind   number, date or text
unit         unit or scale if one is stated, such as %, tonnes, lakh; else null
currency     three-letter code if the value is money; else null
period_text  the span of time the value covers, as printed; else null
as_of_text   the one day the value holds at, as printed; else null
scope        any qualification of what is counted, from the passage or its footnotes; else null
source_kind  prose, table_row, footnote, heading or figure_label
evidence     the stretch of the passage that states the claim, copied letter by letter

Evidence comes from the passage itself, never from its section or footnote lines, and is one unbroken stretch: for a cell of a table it is the
whole row. Several claims may share it. Section and footnote lines may supply dates, units, currency and scope. Do not compute,
convert, round or complete anything, and do not use what you know from elsewhere.

Example. Passage:

=== PASSAGE sample__p0003__c01 ===
[SECTION] Fleet
[FOOTNOTE 1] without leased vans
At 1 May 2021 Harrow Lines ran 310 vans (1), after 284 a year before.

Answer:

{"facts": [{"chunk_id": "sample__p0003__c01", "subject": "Harrow Lines", "attribute": "vans run", "value_raw": "310", "value_kind": "number", "unit": "vans", "currency": null,
"period_text": null, "as_of_text": "1 May 2021", "scope": "without leased vans", "source_kind": "prose", "evidence": "At 1 May 2021 Harrow Lines ran 310 vans (1)"},
{"chunk_id": "sample__p0003__c01", "subject": "Harrow Lines", "attribute": "vans run", "value_raw": "284", "value_kind": "number", "unit": "vans", "currency": null,
"period_text": null, "as_of_text": "a year before", "scope": null, "source_kind": "prose", "evidence": "after 284 a year before"}]}
"""

MERGE = """\
The labels below name measured quantities in one collection of documents. Put labels that name one and the same quantity into one group.
A ratio, a share or a change of a quantity is another quantity, and so is a part of it. A wrong group makes unrelated values look like a
contradiction, a missing one only loses a comparison: if in doubt, keep labels apart.

Answer with JSON alone: [{"canonical": one of the group's labels, "members": [its labels]}, ...]. Labels without a partner may be left out.
"""

ADJUDICATION = """\
Two claims below were checked against their sources. Say how they relate, by one of these words:

corroborates  both say the same
contradicts   both cannot hold, and nothing stated explains the difference
reconciled    a stated period, date, scope or definition explains the difference
superseded    a state that changed: the later claim takes the place of the earlier
unrelated     they are about different things

Go by what is written here alone. Answer contradicts only if nothing stated can explain the difference.
Answer with JSON alone: {"verdict": word, "explanation": two or three sentences for a reader who hasn't seen the documents}.
"""


def texts(required: str, optional: str = "") -> StructType:
    """A type of string fields."""
    return StructType([StructField(n, StringType(), n in optional.split()) for n in (required + " " + optional).split()])


#: What answers look like, for providers that bind theirs to a schema.
CLAIM = texts("chunk_id attribute value_raw value_kind source_kind evidence", "subject unit currency period_text as_of_text scope")
CLAIMS_ANSWER = StructType([StructField("facts", ArrayType(CLAIM), False)])
MERGE_ANSWER = ArrayType(StructType([StructField("canonical", StringType(), False), StructField("members", ArrayType(StringType()), False)]))
VERDICT_ANSWER = texts("verdict explanation")


def claim_text(side: str) -> Column:
    stated = lambda name, none="not stated": F.coalesce(F.nullif(collapsed(F.col(f"{side}.{name}")), F.lit("")), F.lit(none))
    value = collapsed(F.concat_ws(" ", f"{side}.value_raw", f"{side}.unit", f"{side}.currency"))
    rows = [("subject", stated("subject_raw", "the document's own subject")), ("attribute", stated("attribute_raw")), ("value", value), ("period", stated("period_raw")), ("as of", stated("as_of_raw")), ("scope", stated("scope_raw")), ("page", F.col(f"{side}.page_no").cast("string")), ("evidence", shortened(F.col(f"{side}.evidence_text"), 300))]
    return F.concat_ws("\n", *(F.concat(F.lit(f"{name}: "), F.coalesce(text, F.lit(""))) for name, text in rows))


def adjudication_prompts(relations: DataFrame, k: int) -> DataFrame:
    """request_id (the relation's), doc_id, prompt of the k pairs that a model is asked about. relations: with facts a and b."""
    asked = relations.join(F.broadcast(asked_first(relations, k).select("relation_id")), "relation_id", "left_semi")
    prompt = F.concat(F.lit(ADJUDICATION + "\nFirst claim\n"), claim_text("a"), F.lit("\n\nSecond claim\n"), claim_text("b"))
    return asked.select(F.col("relation_id").alias("request_id"), F.col("a.doc_id").alias("doc_id"), prompt.alias("prompt"))


def adjudication_answers(answered: DataFrame) -> DataFrame:
    """relation_id, verdict, explanation of answers (request_id, answer) that give a known verdict."""
    said = answered.select(F.col("request_id").alias("relation_id"), F.from_json("answer", "struct<verdict:string,explanation:string>").alias("s"))
    rows = said.select("relation_id", F.lower(F.trim("s.verdict")).alias("verdict"), F.trim("s.explanation").alias("explanation"))
    return rows.where(F.col("verdict").isin(*MODEL_VERDICTS))


def merge_prompt(sizes: DataFrame) -> DataFrame:
    """One row (request_id, doc_id, prompt) that offers the labels of families (label, n_facts) in order; none if fewer than two are worth it."""
    listed = offered_labels(sizes).agg(F.array_sort(F.collect_list("label")).alias("labels")).where(F.size("labels") >= 2)
    prompt = F.concat(F.lit(MERGE + "\nLabels:\n"), F.array_join(F.transform("labels", lambda x: F.concat(F.lit("- "), x)), "\n"))
    return listed.select(F.lit("families").alias("request_id"), F.lit(None).cast("string").alias("doc_id"), prompt.alias("prompt"))


def merge_groups(answered: DataFrame) -> DataFrame:
    """canonical, members of answers; an answer that can't be read gives no group."""
    groups = F.explode(F.from_json("answer", "array<struct<canonical:string,members:array<string>>>"))
    return answered.select(groups.alias("g")).select("g.canonical", F.array_distinct("g.members").alias("members")).where("canonical IS NOT NULL AND size(members) > 1")
