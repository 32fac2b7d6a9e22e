"""Layout rules on the cases that are known to go wrong."""

import math
import random
import re
import time

from pyspark.sql import functions as F

from attestor.operators import layout as L
from attestor.operators import passages as P

SCHEMA = "doc_id string, page_no int, line_id string, text string, left double, top double, right double, bottom double, font_size double, page_width double, page_height double"


def page(spark, lines, size=10.0):
    rows = [("d", 1, f"{i:03d}", t, float(x), float(y), float(r), float(b), float(f[0]) if f else size, 1200.0, 800.0) for i, (t, x, y, r, b, *f) in enumerate(lines)]
    return spark.createDataFrame(rows, SCHEMA)


def grouped(spark, lines):
    flow = L.ordered(page(spark, lines))
    got = L.blocks(flow).join(flow.select("pos", "text"), "pos").collect()
    out: dict = {}
    for r in sorted(got, key=lambda r: r.pos):
        out.setdefault(r.block, []).append(r.text)
    return sorted(out.values())


def test_tile_with_superscript_is_one_block(spark):
    assert grouped(spark, [("98,135", 1002, 100, 1111, 120), ("(1,5)", 1112, 100, 1142, 108), ("Workforce strength", 1002, 124, 1094, 134)]) == [["98,135", "(1,5)", "Workforce strength"]]


def test_bridging_superscript_does_not_join_two_numbers(spark):
    blocks = grouped(spark, [(">33,200", 100, 100, 186, 120), ("(3,4)", 187, 100, 227, 108), ("18,793", 221, 100, 300, 120)])
    assert not any(">33,200" in b and "18,793" in b for b in blocks)


def test_tall_headline_does_not_swallow_the_next_tile(spark):
    blocks = grouped(spark, [("52", 100, 100, 200, 152), ("label", 100, 155, 160, 166), ("next", 100, 215, 160, 226)])
    assert ["next"] in blocks and ["52", "label"] in blocks


def test_footnotes_continue_and_close(spark):
    lines = [("Body", 50, 100, 300, 110), ("(1) first note", 50, 600, 300, 608, 8.0), ("goes on", 60, 612, 300, 620, 8.0), ("far away", 300, 625, 400, 633, 8.0), ("after", 50, 640, 300, 648, 8.0), ("* star note", 50, 660, 300, 668, 8.0), ("(1) again", 50, 680, 300, 688, 8.0)]
    got = {r.marker: r.body for r in L.footnotes(L.footnote_lines(L.ordered(page(spark, lines)))).collect()}
    assert got == {"1": "again", "*": "star note"}


def test_furniture_goes_before_footnotes(spark):
    lines = [("(2) note", 50, 700, 300, 708, 8.0), ("Page 7", 50, 780, 90, 788, 8.0)]
    got = {r.marker: r.body for r in L.footnotes(L.footnote_lines(L.ordered(page(spark, lines)))).collect()}
    assert got == {"2": "note"}


def test_heading_takes_the_upper_median(spark):
    lines = [("Big", 50, 100, 300, 120, 14.0), ("a", 50, 300, 300, 310, 10.0), ("b", 50, 790, 300, 798, 10.0)]
    assert L.headings(page(spark, lines)).first().heading == "Big"
    assert L.headings(page(spark, lines[1:])).first().heading == ""


def test_header_row_alone_is_no_table(spark):
    rows = spark.createDataFrame([("d", 1, 1, 1, ["Corporate Overview", "Statutory Reports", None]), ("d", 1, 2, 1, ["Total equity", "9,177"]), ("d", 1, 2, 2, ["Debt", "114"])], "doc_id string, page_no int, table_no int, row_no int, cells array<string>")
    prose = spark.createDataFrame([("d", 1, "nothing")], "doc_id string, page_no int, text string")
    kept = L.kept_tables(rows, prose)
    assert [r.line for r in kept.orderBy("row_no").collect()] == ["Total equity | 9,177", "Debt | 114"]
    lines = page(spark, [("total EQUITY", 1, 1, 9, 9), ("Equity", 1, 20, 9, 29)])
    assert [r.text for r in L.without_table_lines(lines, kept).collect()] == ["Equity"]


def test_control_characters_and_references(spark):
    df = spark.createDataFrame([("\x07 a\t b  ", "98,135\n(1,5)\n[2] (1)")], "t string, r string")
    row = df.select(L.cleaned(F.col("t")).alias("t"), L.references(F.col("r")).alias("r")).first()
    assert row.t == "a b" and row.r == ["1", "5", "2"]


def test_passages_round_trip_and_headers(spark):
    text = "98,135\n(1,5)\nWorkforce strength   \n\n  " + "Some words here. " * 400 + "\n\n" + L.TABLES_MARK + "\nTABLE 1\na | b\n\n" + L.FOOTNOTES_MARK + "\n(1) one\n(5) five 😀"
    pages = spark.createDataFrame([("d", 3, text, "Head", {"1": "one", "2": "two", "5": "five"}), ("e", 1, "  \n ", "", {}), ("f", 1, None, None, None)], "doc_id string, page_no int, raw_text string, section_heading string, footnotes map<string,string>")
    got = P.chunks(pages).orderBy("chunk_id").collect()
    assert all(text[r.char_start : r.char_end] == r.text for r in got)
    assert [r.kind for r in got] == ["prose", "prose", "table", "footnotes"] and got[0].chunk_id == "d__p0003__c00"
    assert got[0].context_header == "[SECTION] Head\n[FOOTNOTE 1] one\n[FOOTNOTE 5] five"
    assert got[3].context_header == "[SECTION] Head"
    assert P.misplaced(P.chunks(pages), pages).isEmpty()
    assert not any(m in r.text for r in got for m in (L.TABLES_MARK, L.FOOTNOTES_MARK))


def test_names_are_counted_as_matches_between_word_boundaries(spark):
    """Two names with one separator between them are two."""
    said = ["Thtint Thtint st st st", "Revenue,Profit fell over it all", "a Revenue² Profit fell over it", "Revenue\u0301 Profit\u203f fell over it", "Revenue½ Profit fell over it", "_Revenue Profit fell over it", "ÉRevenue Profité Cost Loss fell", "one two three Four five"]
    got = spark.createDataFrame(list(enumerate(said)), "i int, text string").select("i", P.why_skipped(F.col("text")).alias("why")).orderBy("i").collect()
    assert [r.why is None for r in got] == [len(re.findall(r"\b[A-Z][a-z]{2,}\b", s)) >= 2 for s in said]


def test_packing_never_exceeds_the_limit_unless_alone(spark):
    df = spark.createDataFrame([([400, 700, 300, 1400, 10],)], "w array<int>")
    spans = F.transform("w", lambda w, i: F.struct(i.alias("start"), (i + 1).alias("end"), w.alias("words")))
    assert [(s.start, s.end, s.words) for s in df.select(P.packed(spans).alias("p")).first().p] == [(0, 1, 400), (1, 3, 1000), (3, 4, 1400), (4, 5, 10)]


def test_every_order_line_becomes_a_line(spark):
    from attestor.sources import adapters

    data = "/root/testdata/sf0.001"
    lineitem = adapters.table(spark, data, "lineitem")
    got = adapters.lines(spark, data)
    assert got.count() == lineitem.count()
    assert {r.k for r in got.selectExpr("CAST(substr(line_id, 1, 10) AS INT) % 4 AS k").distinct().collect()} == {0, 1, 2, 3}


def test_gutters_equal_a_walk_over_slices(spark):
    """Random pages against slices one by one; some lines lie off the page, and some pages have none."""
    rng = random.Random(5)
    rows = []
    for p in range(300):
        width = rng.choice([612.0, 200.0, 841.5])
        for _ in range(rng.randint(1, 12)):
            left = rng.uniform(-0.1, 1.05) * width
            rows.append((f"d{p % 7}", p, left, left + rng.uniform(-0.02, 0.25) * width, width))
    want = {}
    for p in range(300):
        own = [r for r in rows if r[1] == p]
        slices = sorted({s for r in own for s in range(max(0, math.floor(r[2] / (r[4] / 200))), min(199, math.floor(r[3] / (r[4] / 200))) + 1)})
        ends = [b * (own[0][4] / 200) for a, b in zip(slices, slices[1:], strict=False) if b - a - 1 >= 8]
        if ends:
            want[(own[0][0], p)] = ends
    found = L.gutters(spark.createDataFrame(rows, 'doc_id string, page_no int, left double, right double, page_width double'))
    assert {(r.doc_id, r.page_no): r.gutters for r in found.collect()} == want and len(want) > 100
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()  # lines are not multiplied by their slices


def test_prose_is_searched_once_for_each_text_of_a_pages_rows(spark):
    """100,000 equal long rows on a page of 300,000 characters, of which the prose has one kind and not the other; a page without prose keeps all."""
    prose = spark.createDataFrame([("d", 1, "Ten words   of plain prose " * 12_000 + "Net Income of the year 17")], "doc_id string, page_no int, text string")
    n = spark.range(100_000)
    cells = F.when(F.col("id") % 2 == 0, F.array(F.lit("net income of"), F.lit(" the year 17"))).otherwise(F.array(F.lit("net income of"), F.lit("the other year")))
    rows = n.select(F.lit("d").alias("doc_id"), F.when(F.col("id") < 99_990, 1).otherwise(2).alias("page_no"), F.lit(1).alias("table_no"), F.col("id").cast("int").alias("row_no"), cells.alias("cells"))
    began = time.time()
    kept = L.kept_tables(rows, prose).groupBy("page_no", F.col("row_no") % 2).count().collect()
    assert {tuple(r) for r in kept} == {(1, 1, 49_995), (2, 0, 5), (2, 1, 5)}
    assert time.time() - began < 60
