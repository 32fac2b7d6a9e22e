"""Pages from positioned lines: furniture, footnotes, blocks, columns, headings, tables, page text.

Lines have doc_id, page_no, line_id, text, left, top, right, bottom, font_size, page_width, page_height.
A page is the unit of every window and group, so nothing grows beyond a page.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.parsing import bound
from attestor.functions.text import collapsed, trimmed
from attestor.sources.scratch import stored

# Fixed values.
FURNITURE_FONT = 9.0
FURNITURE_MARGIN = 0.06
FOOTNOTE_REGION = 0.70
FOOTNOTE_FONT_SLACK = 1.5
FOOTNOTE_LEFT_SLACK = 60.0
TOUCH = 12.0
OVERLAP = 0.25
NARROW = 45.0
GAP_SLACK = 6.0
SLICES = 200
GUTTER_SLICES = 8
MOST_COLUMNS = 4
HEADING_SIZE = 1.4
HEADING_REGION = 0.35
TABLE_ROWS = 2
TABLE_COLUMNS = 2
ROW_REPEATED = 20
TABLES_MARK = "[TABLES ON THIS PAGE]"
FOOTNOTES_MARK = "[FOOTNOTES ON THIS PAGE]"
FOOTNOTE = r"^\s*(?:\(\s*(\d{1,2})\s*\)|\[\s*(\d{1,2})\s*\]|(\d{1,2})[.)]|([*†‡§]))\s+(\S.*)$"
REFERENCE = r"[\(\[]\s*(\d{1,2}(?:\s*,\s*\d{1,2})*)\s*[\)\]]"
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
PAGE = ["doc_id", "page_no"]


def cleaned(text: Column) -> Column:
    """A line's text without control characters, white space collapsed."""
    return collapsed(F.regexp_replace(text, CONTROLS, ""))


def is_furniture() -> Column:
    """Small text in the outer margin at the top or the bottom."""
    c = F.col
    return (c("font_size") <= FURNITURE_FONT) & ((c("bottom") < c("page_height") * FURNITURE_MARGIN) | (c("top") > c("page_height") * (1 - FURNITURE_MARGIN)))


def ordered(lines: DataFrame) -> DataFrame:
    """Lines without furniture, with pos, their place by top and left."""
    return lines.where(~is_furniture()).withColumn("pos", F.row_number().over(Window.partitionBy(*PAGE).orderBy("top", "left", "line_id")))


def footnote_lines(lines: DataFrame) -> DataFrame:
    """Ordered lines with island and marker of the footnote that they belong to; null for all others.

    In the lower part of a page a line that begins with a marker opens a note. What follows
    continues it as long as size and left edge stay near those of its first line; the first line that strays closes it.
    """
    part = lambda i: F.nullif(F.regexp_extract("text", f"(?U){FOOTNOTE}", i), F.lit(""))
    low = lines.where(F.col("top") >= F.col("page_height") * FOOTNOTE_REGION).withColumn("opens", F.coalesce(part(1), part(2), part(3), part(4)))
    order = Window.partitionBy(*PAGE).orderBy("pos")
    low = low.withColumn("island", F.count("opens").over(order)).where("island > 0")
    within = Window.partitionBy(*PAGE, "island").orderBy("pos")
    first = lambda c: F.first(c).over(within)
    near = (F.abs(F.col("font_size") - first("font_size")) <= FOOTNOTE_FONT_SLACK) & (F.abs(F.col("left") - first("left")) <= FOOTNOTE_LEFT_SLACK)
    low = low.withColumns({"near": near.cast("int"), "marker": first("opens")}).withColumn("open", F.min("near").over(within)).where("open = 1")
    said = F.when(F.col("opens").isNotNull(), trimmed(F.regexp_extract("text", f"(?U){FOOTNOTE}", 5))).otherwise(F.col("text"))
    return low.select(*PAGE, "pos", "line_id", "island", "marker", said.alias("said"))


def footnotes(noted: DataFrame) -> DataFrame:
    """doc_id, page_no, marker, body of footnote_lines; of a marker that repeats the last note stays."""
    bodies = noted.groupBy(*PAGE, "island", "marker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "said"))), lambda s: s["said"]), " ").alias("body"))
    return bodies.groupBy(*PAGE, "marker").agg(F.max_by("body", "island").alias("body"))


def references(text: Column) -> Column:
    """Distinct footnote markers that a text refers to, in their order."""
    groups = F.regexp_extract_all(text, F.lit(f"(?U){REFERENCE}"), 1)
    return F.array_distinct(F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, ","))), trimmed))


def same_column(left_a: Column, right_a: Column, left_b: Column, right_b: Column) -> Column:
    """Two ranges share a column: a narrow one by nearly touching, others by overlapping a quarter of the narrower."""
    narrower = F.greatest(F.lit(1.0), F.least(right_a - left_a, right_b - left_b))
    overlap = F.least(right_a, right_b) - F.greatest(left_a, left_b)
    return F.when(narrower <= NARROW, F.greatest(F.lit(0.0), -overlap) <= TOUCH).otherwise((overlap > 0) & (overlap / narrower >= OVERLAP))


def vertically_close(top: Column, height: Column, block_bottom: Column, least_height: Column) -> Column:
    gap = top - block_bottom
    return (gap <= 0) | (gap <= F.least(least_height, height) + GAP_SLACK)


def neighbours(lines: DataFrame) -> DataFrame:
    """Each line with the one before it on the page: whether they share a column and stand close."""
    order = Window.partitionBy(*PAGE).orderBy("pos")
    before = lambda c: F.lag(c).over(order)
    joined = lines.withColumns({f"p_{c}": before(c) for c in ("left", "right", "top", "bottom")}).where("p_left IS NOT NULL")
    c = F.col
    close = vertically_close(c("top"), c("bottom") - c("top"), c("p_bottom"), c("p_bottom") - c("p_top"))
    return joined.select(*PAGE, "line_id", same_column(c("p_left"), c("p_right"), c("left"), c("right")).alias("same_column"), close.alias("close"))


def grouped(boxes: list[tuple[float, float, float, float]]) -> list[int]:
    """The block of each line (left, right, top, bottom) of a page, in order.

    A sweep from line to line that keeps the blocks in the order in which they were opened and, whenever they have doubled, drops those that no line
    still to come can join, as it lies too far below. So a line looks at the blocks near it, not at all of the page.
    """
    least_top = np.minimum.accumulate(np.array([x[2] for x in boxes], float)[::-1])[::-1].tolist() if boxes else []
    open_: list[tuple[float, float, float, float, int]] = []  # left, right, bottom, least height, number
    out, opened, full = [], 0, 16
    for (left, right, top, bottom), rest in zip(boxes, least_top, strict=True):
        if len(open_) >= full:
            open_ = [x for x in open_ if rest - x[2] <= max(x[3] + GAP_SLACK, 0)]
            full = max(16, 2 * len(open_))
        best, least, width, height = -1, None, right - left, bottom - top
        for i, (bl, br, bb, bh, _) in enumerate(open_):
            gap = top - bb
            if (least is not None and gap >= least) or (gap > 0 and gap > min(bh, height) + GAP_SLACK):
                continue
            narrower, overlap = max(1.0, min(width, br - bl)), min(right, br) - max(left, bl)
            if max(0.0, -overlap) <= TOUCH if narrower <= NARROW else overlap > 0 and overlap / narrower >= OVERLAP:
                best, least = i, gap
        if best < 0:
            open_.append((left, right, bottom, height, opened))
            out.append(opened)
            opened += 1
        else:
            bl, br, bb, bh, number = open_[best]
            open_[best] = min(bl, left), max(br, right), max(bb, bottom), min(bh, height), number
            out.append(number)
    return out


def blocks(lines: DataFrame) -> DataFrame:
    """doc_id, page_no, pos, block of ordered lines: each joins the block nearest above it that shares its column and stands close, or opens one.

    What a line joins depends on all lines before it, so a page is swept in order, in one group.
    """
    schema = "doc_id string, page_no int, pos int, block int"

    def sweep(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("pos")
        return page[["doc_id", "page_no", "pos"]].assign(block=grouped(list(page[["left", "right", "top", "bottom"]].itertuples(index=False, name=None))))

    return lines.select(*PAGE, "pos", "left", "right", "top", "bottom").groupBy(*PAGE).applyInPandas(sweep, schema)


def gutters(boxes: DataFrame) -> DataFrame:
    """doc_id, page_no, gutters (positions) of pages that have any. boxes: doc_id, page_no, left, right, page_width.

    The page's width is cut into slices; a run of empty ones between text, wide enough, is a gutter. What lines cover is a set of bits, so a page
    is one row of few numbers before anything is shuffled. Each number has the slices before its own as well, as many as a gutter needs.
    """
    own = 48 - GUTTER_SLICES
    starts = list(range(-GUTTER_SLICES, SLICES - GUTTER_SLICES, own))
    left_by = lambda x, n: F.call_function("shiftleft", x, n)
    one, names = F.lit(1).cast("long"), [f"w{k}" for k in range(len(starts))]
    slice_of = lambda x: F.floor(F.col(x) / (F.col("page_width") / SLICES)).cast("int")
    first, last = F.greatest(F.lit(0), slice_of("left")), F.least(F.lit(SLICES - 1), slice_of("right"))

    def covered(start: int) -> Column:
        low, high = F.greatest(F.col("first"), F.lit(start)), F.least(F.col("last"), F.lit(start + 47))
        return F.bit_or(F.when(low <= high, left_by(left_by(one, high - low + 1) - 1, low - start)).otherwise(F.lit(0).cast("long")))

    spans = boxes.select(*PAGE, "page_width", first.alias("first"), last.alias("last")).where("first <= last")
    by_width = spans.groupBy(*PAGE, "page_width").agg(*(covered(s).alias(n) for s, n in zip(starts, names, strict=True)))
    pages = by_width.groupBy(*PAGE).agg(*(F.bit_or(n).alias(n) for n in names), F.array_sort(F.collect_list(F.struct("page_width", F.array(*names).alias("w")))).alias("widths"))

    def after_gap(n: str) -> Column:
        before = F.lit(0).cast("long")
        for k in range(1, GUTTER_SLICES + 1):
            before = before.bitwiseOR(F.shiftleft(n, k))
        return F.col(n).bitwiseAND(F.lit(((1 << own) - 1) << GUTTER_SLICES)).bitwiseAND(F.bitwise_not(before))

    has = lambda w, s: F.call_function("shiftright", F.get(w, F.floor(s / own).cast("int")), s % own + GUTTER_SLICES).bitwiseAND(one) == 1
    width = lambda s: F.get(F.filter("widths", lambda x: has(x["w"], s)), F.lit(0))["page_width"]
    ends = [after_gap(n) for n in names]
    # the first slice with text ends no gutter, as nothing stands before it
    found = pages.where(sum((F.bit_count(e) for e in ends), F.lit(0)) > 1)
    slices = bound(F.array(*ends), lambda e: F.slice(F.filter(F.sequence(F.lit(0), F.lit(SLICES - 1)), lambda s: has(e, s)), 2, SLICES))
    return found.select(*PAGE, F.array_sort(F.transform(slices, lambda s: s * (width(s) / SLICES))).alias("gutters"))


def reading_order(boxes: DataFrame, key: str) -> DataFrame:
    """boxes with place: by column, top and left on a page of two to four columns, else by top and left. key breaks ties."""
    columns = F.coalesce(F.size("gutters"), F.lit(0)) + 1
    column = F.when(columns.between(2, MOST_COLUMNS), F.size(F.filter("gutters", lambda g: F.col("left") >= g))).otherwise(0)
    joined = boxes.join(gutters(boxes), PAGE, "left").withColumn("column", column)
    return joined.withColumn("place", F.row_number().over(Window.partitionBy(*PAGE).orderBy("column", "top", "left", key))).drop("gutters")


def headings(lines: DataFrame) -> DataFrame:
    """doc_id, page_no, heading: the largest text near the top that is clearly larger than the page's upper median; '' if none."""
    sizes = F.array_sort(F.collect_list("font_size"))
    measured = lines.groupBy(*PAGE).agg(F.element_at(sizes, F.floor(F.size(sizes) / 2).cast("int") + 1).alias("body"), F.max("bottom").alias("deepest"))
    judged = lines.join(measured, PAGE)
    fits = (F.col("deepest") > 0) & (F.col("font_size") >= F.col("body") * HEADING_SIZE) & (F.col("top") <= F.col("deepest") * HEADING_REGION)
    best = F.min(F.when(fits, F.struct(-F.col("font_size"), F.col("top"), F.col("line_id"), F.col("text"))))
    return judged.groupBy(*PAGE).agg(best.alias("best")).select(*PAGE, F.coalesce("best.text", F.lit("")).alias("heading"))


def flattened(rows: DataFrame) -> DataFrame:
    """Table rows (doc_id, page_no, table_no, row_no, cells) as lines, cells collapsed and joined; rows of fewer than two filled cells go."""
    cells = F.transform("cells", lambda c: F.coalesce(collapsed(c), F.lit("")))
    flat = rows.withColumn("cells", cells).where(F.size(F.filter("cells", lambda c: c != "")) >= TABLE_COLUMNS)
    return flat.withColumn("line", F.array_join("cells", " | "))


def kept_tables(rows: DataFrame, prose: DataFrame) -> DataFrame:
    """Lines of tables of at least two rows and columns that the page's prose (doc_id, page_no, text) doesn't hold already.

    A row that the prose contains is dropped, a table stays if two rows survive.
    """
    shape = Window.partitionBy(*PAGE, "table_no")
    width = F.first("cells").over(shape.orderBy("row_no"))
    sound = rows.withColumns({"n": F.count(F.lit(1)).over(shape), "width": F.size(width)}).where((F.col("n") >= TABLE_ROWS) & (F.col("width") >= TABLE_COLUMNS)).drop("n", "width")
    said = F.lower(collapsed(F.replace("line", F.lit("|"), F.lit(" "))))
    flat = flattened(sound).withColumn("said", F.when(F.length(said) > ROW_REPEATED, said))
    # a page's prose is looked through once for each text of its rows, not for each row, and travels with none
    known = prose.select(*PAGE, F.lower(collapsed(F.coalesce("text", F.lit("")))).alias("known"))
    repeated = flat.where("said IS NOT NULL").select(*PAGE, "said").distinct().join(known, PAGE).where(F.contains("known", "said")).select(*PAGE, "said")
    fresh = flat.join(repeated, [*PAGE, "said"], "left_anti").select(*rows.columns, "line")
    return fresh.withColumn("left_over", F.count(F.lit(1)).over(shape)).where(F.col("left_over") >= TABLE_ROWS).drop("left_over")


def table_cells(kept: DataFrame) -> DataFrame:
    """doc_id, page_no, cell: the distinct lower-case cells of kept tables."""
    return kept.select(*PAGE, F.explode("cells").alias("cell")).select(*PAGE, F.lower("cell").alias("cell")).where("cell <> ''").distinct()


def without_table_lines(lines: DataFrame, kept: DataFrame) -> DataFrame:
    """Lines whose text isn't a whole cell of a kept table on their page."""
    cells = table_cells(kept)
    same = [lines.doc_id == cells.doc_id, lines.page_no == cells.page_no, F.lower(lines.text) == cells.cell]
    return lines.join(cells, same, "left_anti")


def page_texts(placed: DataFrame, kept: DataFrame, notes: DataFrame) -> DataFrame:
    """doc_id, page_no, raw_text: prose blocks, then tables, then footnotes by marker.

    placed: doc_id, page_no, place (of the block), text (of the block).
    """
    joined = lambda x, key, text, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*key, text))), lambda s: s[text]), sep)
    prose = placed.groupBy(*PAGE).agg(joined(None, ["place"], "text", "\n\n").alias("prose"))
    tables = kept.groupBy(*PAGE, "table_no").agg(joined(None, ["row_no"], "line", "\n").alias("lines"))
    tables = tables.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_no", "lines"))), lambda s: F.concat(F.lit("TABLE "), s["table_no"].cast("string"), F.lit("\n"), s["lines"])), "\n\n").alias("tables"))
    noted = notes.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("marker", "body"))), lambda s: F.concat(F.lit("("), s["marker"], F.lit(") "), s["body"])), "\n").alias("notes"))
    none = F.lit(None).cast("string")
    every = prose.select(*PAGE, "prose", none.alias("tables"), none.alias("notes")).union(tables.select(*PAGE, none, "tables", none)).union(noted.select(*PAGE, none, none, "notes"))
    all_ = every.groupBy(*PAGE).agg(*(F.max(c).alias(c) for c in ("prose", "tables", "notes")))
    sections = F.array(F.when(trimmed(F.col("prose")) != "", F.col("prose")), F.concat(F.lit(TABLES_MARK + "\n"), "tables"), F.concat(F.lit(FOOTNOTES_MARK + "\n"), "notes"))
    return all_.select(*PAGE, F.array_join(F.array_compact(sections), "\n\n").alias("raw_text"))


def block_texts(lines: DataFrame, block: DataFrame) -> DataFrame:
    """doc_id, page_no, block, text, left, right, top, bottom, page_width: blocks of lines, in their order."""
    joined = lines.join(block, [*PAGE, "pos"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), "\n")
    return joined.groupBy(*PAGE, "block").agg(text.alias("text"), F.min("left").alias("left"), F.max("right").alias("right"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.max("page_width").alias("page_width"))


def ingested(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id, page_no, raw_text, section_heading, footnotes of pages: the whole chain from lines and raw tables."""
    flow = stored(ordered(lines), "flow")
    noted = footnote_lines(flow)
    notes = stored(footnotes(noted), "notes")
    prose = stored(flow.join(noted.select(*PAGE, "pos"), [*PAGE, "pos"], "left_anti"), "prose")
    block = stored(blocks(prose), "blocks")
    shaped = block_texts(prose, block)
    spoken = shaped.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda s: s["text"]), " ").alias("text"))
    kept = stored(kept_tables(tables, spoken), "tables")
    left = without_table_lines(prose, kept)
    shaped = reading_order(block_texts(left, block), "block")
    texts = page_texts(shaped, kept, notes)
    heads = headings(flow).withColumnRenamed("heading", "section_heading")
    maps = notes.groupBy(*PAGE).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("marker", "body")))).alias("footnotes"))
    empty = F.create_map().cast("map<string,string>")
    return texts.join(heads, PAGE, "left").join(maps, PAGE, "left").select(*PAGE, "raw_text", F.coalesce("section_heading", F.lit("")).alias("section_heading"), F.coalesce("footnotes", empty).alias("footnotes"))


def lost_lines(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines whose text isn't found in the text of their page."""
    return lines.join(pages.select(*PAGE, "raw_text"), PAGE).where(~F.contains("raw_text", "text")).select(*PAGE, "line_id", "text")


def document_summary(pages: DataFrame) -> DataFrame:
    """Per document: pages, characters, pages with tables and footnotes, and nearly empty pages."""
    c = F.col
    return pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"), F.sum(F.length("raw_text")).alias("characters"), F.count_if(F.contains("raw_text", F.lit(TABLES_MARK))).alias("with_tables"),
        F.count_if(F.contains("raw_text", F.lit(FOOTNOTES_MARK))).alias("with_footnotes"), F.array_join(F.array_sort(F.collect_list(F.when(F.length("raw_text") < 100, c("page_no")))).cast("array<string>"), ",").alias("nearly_empty"),
    )
