"""Lines that recur across documents, by a log-template tree of fixed depth.

A line, whose tokens with a digit are variable fields, goes down the tree by its number of tokens and its first DEPTH
tokens. A leaf holds a template for each whole line, and, where at least LEAST_REST tokens follow the leading
ones, one for each first and each second half of the rest: there the other half is variable. So more than half of a
template's tokens are constant, a line belongs to three templates at most, and lines that merely share a leaf
say nothing about each other. A template that lines of at least LEAST_DOCUMENTS different texts have is
dropped everywhere; a whole line of more than LONG tokens already from two texts on. Copies of a text are one
text: they are the business of deduplication of documents.

Fields anywhere come from leaves of their own, by the number of tokens and the first FIELD_DEPTH of them: in a leaf with lines of at least LEAST_DOCUMENTS
texts a token is constant at a place if that many lines have it there and no less than a CONSTANT_SHARE of the leaf's, else a field. Lines that are one template
then and have constants at more than half of the places after the leading ones recur if LEAST_DOCUMENTS texts have them and no less than a TEMPLATE_SHARE of the leaf's. The
shares keep common words of a large leaf from passing for a template, whatever the size of the corpus.
Only built-in expressions run; counts are summed up before anything is shuffled, and no line list of a
leaf is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.work import passing, probed, stored, whole

DEPTH = 4
LEAST_REST = 4
LEAST_DOCUMENTS = 10
LONG = 50
FIELD_DEPTH, CONSTANT_SHARE, TEMPLATE_SHARE = 3, 1 / 16, 1 / 64
FIELD = "<*>"
#: White space of a line other than single spaces; where none occurs, lines are cut without a regular expression.
ODD_SPACE = ("  ", "\t", "\x0b", "\x0c", "\r")
SPACES = r"[\x20\x09\x0B-\x0D]+"
VARIABLE = "[^ ]*[0-9][^ ]*"


def lines_of(docs: DataFrame) -> DataFrame:
    """key (hash of doc_id and text), same (hash of the text), at, line (tokens with single spaces between them) of every line that isn't blank."""
    odd = F.contains("text", F.lit(ODD_SPACE[0]))
    for space in ODD_SPACE[1:]:
        odd = odd | F.contains("text", F.lit(space))
    spaced = F.when(odd, F.regexp_replace("text", SPACES, " ")).otherwise(F.col("text"))
    lines = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.xxhash64("text").alias("same"), F.posexplode(F.split(spaced, "\n")).alias("at", "line"))
    return lines.withColumn("line", F.trim("line")).where("line <> ''")


def templates_of(lines: DataFrame) -> DataFrame:
    """lines with templates: an array of up to three texts, <*> for variable fields and .. for a variable half, and length, masked."""
    length = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    masked = F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", VARIABLE, FIELD)).otherwise(F.col("line"))
    shaped = lines.select("*", length.alias("length"), masked.alias("masked"))
    half = f"CAST((length - {DEPTH}) DIV 2 AS INT)"
    first = F.expr(f"concat_ws(' ', length, substring_index(masked, ' ', {DEPTH} + {half}), '..')")
    second = F.expr(f"concat_ws(' ', length, substring_index(masked, ' ', {DEPTH}), '..', substring_index(masked, ' ', CAST({DEPTH} + {half} - length AS INT)))")
    halves = F.when(F.col("length") >= DEPTH + LEAST_REST, F.array("masked", first, second)).otherwise(F.array("masked"))
    return shaped.withColumn("templates", halves)


def placed(docs: DataFrame) -> DataFrame:
    """key, same, at, template (two hashes of its text; together they tell templates apart), least: the texts it takes to recur, of all lines and templates; leaf in the row of a line's first template."""
    lines = templates_of(lines_of(docs)).withColumn("leaf", leaf())
    hashes = F.transform("templates", lambda t: F.struct(F.xxhash64(t).alias("h"), F.hash(t).alias("c")))
    return lines.select("key", "same", "at", (F.col("length") > LONG).alias("long"), "leaf", F.posexplode(hashes).alias("kind", "template")).select(
        "key", "same", "at", F.col("template.h").alias("h"), F.col("template.c").alias("c"), F.when(F.col("long") & (F.col("kind") == 0), 2).otherwise(LEAST_DOCUMENTS).alias("least"), F.when(F.col("kind") == 0, F.col("leaf")).alias("leaf")
    )


def leaf() -> Column:
    """The leaf in which a line's fields are looked for; null for lines of few tokens."""
    return F.when(F.col("length") >= DEPTH + LEAST_REST, F.xxhash64("length", F.substring_index("masked", " ", FIELD_DEPTH)))


def recurring(lines: DataFrame) -> DataFrame:
    """h, c, documents of the templates that lines of enough different texts have. lines: placed()."""
    twice = stored(lines.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.max("least").alias("least")).where("n >= least").select("h", "c"), "lines-twice")
    again = passing(lines, "h", twice).join(twice, ["h", "c"]).groupBy("h", "c", "same").agg(F.max("least").alias("least"))
    return again.groupBy("h", "c").agg(F.count(F.lit(1)).alias("documents"), F.max("least").alias("least")).where("documents >= least").select("h", "c", "documents")


def with_fields(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """key, at, same, leaf, template of the lines that are a recurring template with fields at any place. lines: placed(), of the same docs.

    Only leaves with lines of enough texts are looked into. A leaf's constants are one row of at most 1 / CONSTANT_SHARE tokens a place; each of its lines is
    masked by that row, so tokens are counted, but neither joined nor gathered.
    """
    first = lines.where("leaf IS NOT NULL").select("leaf", "same")
    twice = stored(first.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_DOCUMENTS).select("leaf"), "lines-leaves")
    texts = passing(first, "leaf", twice).join(twice, "leaf").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("texts"))
    leaves = stored(texts.where(F.col("texts") >= LEAST_DOCUMENTS), "lines-leaves")
    shaped = templates_of(lines_of(docs)).withColumn("leaf", leaf()).select("key", "same", "at", "masked", "leaf")
    members = stored(passing(shaped, "leaf", leaves).join(leaves, "leaf"), "lines-members")

    one = stored(members.groupBy("leaf", "same", "masked").agg(F.first("texts").alias("texts")), "lines-worded")
    sizes = one.groupBy("leaf").agg(F.count(F.lit(1)).alias("lines"))
    counted = one.select("leaf", F.posexplode(F.split("masked", " ")).alias("place", "token")).groupBy("leaf", "place", "token").agg(F.count(F.lit(1)).alias("n"))
    common = (F.col("token") != FIELD) & (F.col("n") >= LEAST_DOCUMENTS) & (F.col("n") >= F.col("lines") * CONSTANT_SHARE)
    by_place = stored(counted, "lines-tokens").join(stored(sizes, "lines-sizes"), "leaf").groupBy("leaf", "place").agg(F.collect_list(F.when(common, F.col("token"))).alias("tokens"))
    constants = by_place.groupBy("leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "tokens"))), lambda s: s["tokens"]).alias("constants"))

    named = one.join(stored(constants, "lines-constants"), "leaf").withColumn("tokens", F.split("masked", " "))
    kept = F.transform("tokens", lambda t, i: F.when(F.array_contains(F.get("constants", i), t), t).otherwise(FIELD))
    named = named.select("leaf", "same", "masked", "texts", kept.alias("kept"))
    fixed = F.size(F.filter("kept", lambda t, i: (i >= FIELD_DEPTH) & (t != FIELD)))
    named = stored(named.where(2 * fixed > F.size("kept") - FIELD_DEPTH).select("leaf", "same", "masked", "texts", F.array_join("kept", " ").alias("template")), "lines-named")
    spread = named.groupBy("leaf", "template", "same").agg(F.first("texts").alias("texts")).groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("documents"), F.first("texts").alias("texts"))
    good = stored(spread.where((F.col("documents") >= LEAST_DOCUMENTS) & (F.col("documents") >= F.col("texts") * TEMPLATE_SHARE)).select("leaf", "template"), "lines-fields")
    gone = stored(named.join(good, ["leaf", "template"]).select("leaf", "same", "masked", "template"), "lines-gone")
    return members.join(gone, ["leaf", "same", "masked"]).select("key", "at", "same", "leaf", "template")


def templates(docs: DataFrame) -> DataFrame:
    """template, documents: the text of every template that recurs and the number of different texts it occurs in.

    Null and blank lines have none; repeated rows count as one text. An empty table gives an empty result.
    """
    lines = stored(placed(docs.select("doc_id", "text")), "lines-placed")
    kept = stored(recurring(lines), "lines-templates")
    texts = templates_of(lines_of(docs.select("doc_id", "text"))).select(F.explode("templates").alias("template")).withColumn("h", F.xxhash64("template"))
    named = passing(texts, "h", kept).groupBy("h", F.hash("template").alias("c")).agg(F.min("template").alias("template"))
    fields = with_fields(docs.select("doc_id", "text"), lines).groupBy("leaf", "template").agg(F.countDistinct("same").alias("documents")).select("template", "documents")
    return named.join(kept, ["h", "c"]).select("template", "documents").union(fields).groupBy("template").agg(F.max("documents").alias("documents"))


def dropped(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), kept_text, n_lines, n_dropped: the text without the lines of recurring templates.

    Blank lines stay. A null text stays null, with no lines; an empty text is one blank line. Rows with one text
    count as one text, whatever their doc_id, and lose the same lines. An empty table gives an empty result. Texts without
    a line to drop are never moved.
    """
    lines = stored(placed(docs.select("doc_id", "text")), "lines-placed")
    kept = stored(recurring(lines), "lines-templates")
    hits = passing(lines.select("key", "at", "h", "c"), "h", kept).join(kept.select("h", "c"), ["h", "c"]).select("key", "at")
    hits = hits.union(with_fields(docs.select("doc_id", "text"), lines).select("key", "at")).distinct()
    marked = stored(hits.groupBy("key").agg(F.sort_array(F.collect_list("at")).alias("gone")), "lines-marked")
    packed = docs.select(whole(docs).alias("row"), F.xxhash64("doc_id", "text").alias("key"))
    joined = passing(packed, "key", marked).join(marked.hint("merge"), "key", "left")
    joined = joined.union(probed(packed, "key", marked, "left_anti").select("key", "row", F.lit(None).cast("array<int>").alias("gone")))
    joined = joined.select("row", "gone", F.split("row.text", "\n").alias("lines"))
    # Whether a line goes, by its place: as many false as lie between two that go, then true.
    gaps = F.zip_with("gone", F.concat(F.array(F.lit(-1)), F.slice("gone", 1, F.size("gone") - 1)), lambda x, before: F.concat(F.array_repeat(F.lit(False), x - before - 1), F.array(F.lit(True))))
    flagged = joined.select("row", "gone", "lines", F.flatten(gaps).alias("flags"))
    stays = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x, i: ~F.coalesce(F.get("flags", i), F.lit(False))))
    n, m = F.coalesce(F.size("lines"), F.lit(0)).cast("long"), F.coalesce(F.size(stays), F.lit(0)).cast("long")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(stays, "\n"))
    return flagged.select("row", text.alias("kept_text"), n.alias("n_lines"), (n - m).alias("n_dropped"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, text_sha256 (of the text that is left; null for a null text)."""
    return dropped(docs.select("doc_id", "text")).select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("text_sha256"))
