"""Passages of pages with their offsets, by array functions within the page's own row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.arrays import chain, reach, running, runs
from attestor.functions.parsing import bound
from attestor.functions.text import word_count
from attestor.operators.layout import FOOTNOTES_MARK, TABLES_MARK, references

# Fixed values.
PASSAGE_WORDS = 1000
PARAGRAPH_WORDS = 1500
LEAST_WORDS = 5
LEAST_CAPITALISED = 2
#: A word goes on with letters, numbers of any kind and _, with nothing else; to Java's \b a superscript ends it and a combining mark doesn't.
CAPITALISED = r"(?<![\p{L}\p{N}_])[A-Z][a-z]{2,}(?![\p{L}\p{N}_])"
SYMBOLS = ("*", "†", "‡", "§")
SENTENCE = r"(?sU).+?(?:(?<=[.!?])\s+|\z)"
KINDS = ("prose", "table", "footnotes")


def part(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def regions(text: Column) -> Column:
    """Array of (kind, start, end): prose before any mark, tables and footnotes after theirs; only those that exist."""
    tables, notes = F.instr(text, TABLES_MARK) - 1, F.instr(text, FOOTNOTES_MARK) - 1
    n = F.length(text)
    marks = F.struct(F.when(tables >= 0, tables).alias("t"), F.when(notes >= 0, notes).alias("f"), n.alias("n"))

    def cut(m: Column) -> Column:
        row = lambda kind, start, end: F.struct(F.lit(kind).alias("kind"), start.cast("int").alias("start"), end.cast("int").alias("end"))
        prose = row("prose", F.lit(0), F.least(F.coalesce(m["t"], m["n"]), F.coalesce(m["f"], m["n"])))
        table = F.when(m["t"].isNotNull(), row("table", m["t"] + len(TABLES_MARK), F.when(m["f"] > m["t"], m["f"]).otherwise(m["n"])))
        return F.array_compact(F.array(prose, table, F.when(m["f"].isNotNull(), row("footnotes", m["f"] + len(FOOTNOTES_MARK), m["n"]))))

    return bound(marks, cut)


def tight(piece: Column, start: Column) -> Column:
    """Span (start, end, words) of a piece that begins at start, without white space at its ends."""
    lead = F.length(piece) - F.length(F.regexp_replace(piece, r"(?U)^\s+", ""))
    body = F.length(F.regexp_replace(piece, r"(?U)^\s+|\s+$", ""))
    return bound(F.struct((start + lead).cast("int").alias("start"), body.cast("int").alias("n"), word_count(piece).alias("words")), lambda s: F.struct(s["start"], (s["start"] + s["n"]).alias("end"), s["words"]))


def spans(pieces: Column, start: Column, gap: int) -> Column:
    """Spans of consecutive pieces with `gap` characters between them; those without words go."""

    def cut(ps: Column) -> Column:
        ends = running(F.transform(ps, lambda p: F.length(p) + gap))
        return F.zip_with(ps, F.transform(ends, lambda e, i: (start + e - F.length(F.get(ps, i)) - gap).cast("int")), tight)

    return F.filter(bound(pieces, cut), lambda s: s["words"] > 0)


def paragraphs(text: Column, start: Column, end: Column) -> Column:
    """Spans of paragraphs, parted by blank lines; empty ones go."""
    return spans(F.split(part(text, start, end), "\n\n"), start, 2)


def sentences(text: Column, span: Column) -> Column:
    """Spans of a paragraph's sentences."""
    return spans(F.regexp_extract_all(part(text, span["start"], span["end"]), F.lit(SENTENCE), 0), span["start"], 0)


def broken(text: Column, of: Column) -> Column:
    """Spans with those of too many words replaced by their sentences."""
    return F.flatten(F.transform(of, lambda s: F.when(s["words"] > PARAGRAPH_WORDS, sentences(text, s)).otherwise(F.array(s))))


def packed(of: Column, most: int = PASSAGE_WORDS) -> Column:
    """Consecutive spans joined greedily while their words stay within `most`."""

    def pack(x: Column) -> Column:
        n, sums = F.size(x["of"]), x["sums"]
        starts = chain(F.transform(x["of"], lambda _, i: reach(sums, i, most)))
        words = lambda r: F.get(sums, r["end"] - 1) - F.coalesce(F.get(sums, r["start"] - 1), F.lit(0))
        joined = lambda r: F.struct(F.get(x["of"], r["start"])["start"].alias("start"), F.get(x["of"], r["end"] - 1)["end"].alias("end"), words(r).cast("int").alias("words"))
        return F.transform(bound(starts, lambda s: runs(s, n)), joined)

    return bound(of, lambda spans: bound(F.struct(spans.alias("of"), running(F.transform(spans, lambda s: s["words"])).alias("sums")), pack))


def header(heading: Column, notes: Column, text: Column, kind: Column) -> Column:
    """Section and the footnotes that a passage refers to, or that a symbol attaches to the whole page, by marker."""
    wanted = lambda e: (e["value"] != "") & (F.array_contains(references(text), e["key"]) | e["key"].isin(*SYMBOLS))
    entries = F.array_sort(F.filter(F.map_entries(notes), wanted))
    lines = F.transform(entries, lambda e: F.concat(F.lit("[FOOTNOTE "), e["key"], F.lit("] "), e["value"]))
    none = F.array().cast("array<string>")
    section = F.when(F.coalesce(heading, F.lit("")) != "", F.array(F.concat(F.lit("[SECTION] "), heading))).otherwise(none)
    return F.array_join(F.concat(section, F.when(kind == "footnotes", none).otherwise(F.coalesce(lines, none))), "\n")


def why_skipped(text: Column) -> Column:
    """Why a passage isn't worth a call; null if it is."""
    few = word_count(text) < LEAST_WORDS
    named = F.regexp_count(text, F.lit(CAPITALISED)) >= LEAST_CAPITALISED
    return F.when(few, "too short to hold a claim").when(text.rlike(r"(?U)\d") | named, None).otherwise("no numbers and nothing named")


def region_rows(pages: DataFrame) -> DataFrame:
    """Pages with text, exploded to regions: kind, start, end."""
    there = pages.where(F.regexp_replace(F.coalesce("raw_text", F.lit("")), r"(?U)\s+", "") != "")
    return there.withColumn("region", F.explode(regions(F.col("raw_text")))).select(*pages.columns, "region.*")


def chunks(pages: DataFrame) -> DataFrame:
    """chunk_id, doc_id, page_no, kind, char_start, char_end, context_header, text, was_sent_to_llm, why_skipped of pages.

    pages: doc_id, page_no, raw_text, section_heading, footnotes. Passages are numbered through a page.
    """
    text = F.col("raw_text")
    cuts = lambda r: F.transform(packed(broken(text, paragraphs(text, r["start"], r["end"]))), lambda s: F.struct(r["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    there = pages.where(F.regexp_replace(F.coalesce("raw_text", F.lit("")), r"(?U)\s+", "") != "")
    cut = there.select("doc_id", "page_no", "raw_text", "section_heading", "footnotes", F.posexplode(F.flatten(F.transform(regions(text), cuts))).alias("n", "s"))
    cut = cut.withColumn("text", part(text, F.col("s.start"), F.col("s.end"))).withColumn("why_skipped", why_skipped(F.col("text")))
    head = header(F.col("section_heading"), F.col("footnotes"), F.col("text"), F.col("s.kind"))
    return cut.select(
        F.format_string("%s__p%04d__c%02d", "doc_id", "page_no", "n").alias("chunk_id"), "doc_id", "page_no", F.col("s.kind").alias("kind"), F.col("s.start").alias("char_start"), F.col("s.end").alias("char_end"),
        head.alias("context_header"), "text", F.col("why_skipped").isNull().alias("was_sent_to_llm"), "why_skipped",
    )


def misplaced(chunk: DataFrame, pages: DataFrame) -> DataFrame:
    """Chunks that their page doesn't hold at their offsets; all are looked at, not a sample."""
    joined = chunk.join(pages.select("doc_id", "page_no", "raw_text"), ["doc_id", "page_no"])
    return joined.where(part(F.col("raw_text"), F.col("char_start"), F.col("char_end")) != F.col("text")).select("chunk_id")


def statistics(chunk: DataFrame) -> DataFrame:
    """Per kind: chunks, median (cut to a whole number) and most words, chunks worth a call."""
    n = chunk.withColumn("words", word_count(F.col("text")))
    return n.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.floor(F.median("words")).cast("long").alias("median_words"), F.max("words").alias("most_words"), F.count_if("was_sent_to_llm").alias("sent"))


def exemplars(chunk: DataFrame) -> DataFrame:
    """The passage with the longest header that has a footnote, and the longest of a table."""
    longest = lambda df, by: df.orderBy(F.length(by).desc(), "chunk_id").limit(1).select("chunk_id", "kind")
    return longest(chunk.where("context_header LIKE '%[FOOTNOTE%'"), "context_header").union(longest(chunk.where("kind = 'table'"), "text"))
