"""Evidence found verbatim in its passage or page, with code point offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.parsing import bound
from attestor.functions.text import trimmed, words

SHORTEST = 3


def pattern(evidence: Column) -> Column:
    """A regular expression of the evidence's pieces, taken literally, with any white space between them."""
    quoted = F.transform(words(evidence), lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    return F.array_join(quoted, r"\s+")


def exact(evidence: Column, text: Column) -> Column:
    """Span (start, end) of the first verbatim occurrence, or null."""
    return bound(F.position(evidence, text), lambda p: F.when(p > 0, F.struct((p - 1).alias("start"), (p - 1 + F.length(evidence)).alias("end"))))


def flexible(evidence: Column, text: Column) -> Column:
    """Span of the first occurrence up to white space, or null.

    The matched string itself is located again: its first occurrence is the match, and positions then
    count code points.
    """
    match = F.regexp_substr(text, F.concat(F.lit("(?U)"), pattern(evidence)))
    return bound(match, lambda m: F.when(m.isNotNull() & (m != ""), exact(m, text)))


def value_in_evidence(value: Column, evidence: Column) -> Column:
    """The value occurs in the evidence, apart from case, white space and commas; never if either is empty."""
    bare = lambda x: F.regexp_replace(F.lower(x), r"(?U)[\s,]+", "")
    given = (F.coalesce(value, F.lit("")) != "") & (F.coalesce(evidence, F.lit("")) != "")
    return F.when(given, F.contains(bare(evidence), bare(value))).otherwise(False)


def grounded(claims: DataFrame) -> DataFrame:
    """claims with grounded, grounding_method, char_start, char_end, value_in_evidence, why_rejected.

    claims: evidence_text, value_raw, chunk_text, chunk_char_start, page_text, page_no and any others. Verbatim in the passage comes
    first, then up to white space, then anywhere on the page; a cheaper search that succeeds spares the dearer ones.
    """
    evidence = trimmed(F.coalesce("evidence_text", F.lit("")))
    chunk, page = F.coalesce("chunk_text", F.lit("")), F.coalesce("page_text", F.lit(""))
    shift = lambda s: F.struct((s["start"] + F.coalesce("chunk_char_start", F.lit(0))).alias("start"), (s["end"] + F.coalesce("chunk_char_start", F.lit(0))).alias("end"))
    found = lambda method, s: F.struct(F.lit(method).alias("method"), s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"))

    def named(method: str, inside: bool):
        return lambda s: F.when(s.isNotNull(), found(method, shift(s) if inside else s))

    def search(e: Column) -> Column:
        ways = [("exact", exact(e, chunk), True), ("flexible", flexible(e, chunk), True), ("same_page", exact(e, page), False), ("same_page", flexible(e, page), False)]
        tries = [bound(span, named(method, inside)) for method, span, inside in ways]
        return F.when(F.length(e) >= SHORTEST, F.coalesce(*tries))

    said = claims.withColumn("_e", evidence)
    out = said.withColumn("_f", search(F.col("_e")))
    reason = F.when(F.length("_e") < SHORTEST, F.concat(F.lit("evidence too short: "), "_e")).when(F.col("_f").isNull(), F.concat(F.lit("not found on page "), F.col("page_no").cast("string"), F.lit(": "), F.substring("_e", 1, 120)))
    inside = F.when(F.length("_e") >= SHORTEST, value_in_evidence(F.col("value_raw"), F.col("_e"))).otherwise(False)
    return out.withColumns({
        "grounded": F.col("_f").isNotNull(), "grounding_method": F.col("_f.method"), "char_start": F.col("_f.start"), "char_end": F.col("_f.end"), "value_in_evidence": inside, "why_rejected": reason,
    }).drop("_e", "_f")


def with_sources(facts: DataFrame, chunk: DataFrame, pages: DataFrame) -> DataFrame:
    """facts with chunk_text, chunk_char_start and page_text; what is missing is empty."""
    c = chunk.select("chunk_id", F.col("text").alias("chunk_text"), F.col("char_start").alias("chunk_char_start"))
    p = pages.select("doc_id", "page_no", F.col("raw_text").alias("page_text"))
    return facts.join(c, "chunk_id", "left").join(p, ["doc_id", "page_no"], "left").na.fill({"chunk_text": "", "page_text": "", "chunk_char_start": 0})


def rejections(checked: DataFrame) -> DataFrame:
    """Rows for the failures table."""
    return checked.where("NOT grounded").select(F.lit("ground").alias("stage"), F.lit("not_grounded").alias("kind"), "fact_id", F.substring("why_rejected", 1, 1500).alias("detail"))


def statistics(checked: DataFrame) -> DataFrame:
    """grounding_method, n, with_value: counts by method, null for what was rejected."""
    return checked.groupBy("grounding_method").agg(F.count(F.lit(1)).alias("n"), F.count_if("value_in_evidence").alias("with_value"))
