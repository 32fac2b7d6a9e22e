"""Documents as files: scan, fingerprint and identifier."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from attestor.operators.layout import cleaned


def document_id(name: Column, sha256: Column) -> Column:
    """doc_, the first 48 characters of the file name's slug, and 8 hex digits of its fingerprint."""
    slug = F.regexp_replace(F.lower(F.regexp_replace(name, r"\.[^.]*$", "")), "[^a-z0-9]+", "_")
    return F.concat(F.lit("doc_"), F.regexp_replace(F.substring(slug, 1, 48), "^_+|_+$", ""), F.lit("_"), F.substring(sha256, 1, 8))


def scanned(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """doc_id, filename, sha256, path, length of the files of a folder; their bytes are hashed where they are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.sha2("content", 256).alias("sha256"), "path", "length")
    return named.select(document_id(F.col("filename"), F.col("sha256")).alias("doc_id"), "filename", "sha256", "path", "length")


#: What a decoder gives for each line of text and each row of a table of a document.
LINE = "page_no int, line_id string, text string, left double, top double, right double, bottom double, font_size double, page_width double, page_height double"
ROW = "page_no int, table_no int, row_no int, cells array<string>"


FAILURE = "page_no int, error string"


def decoded(spark: SparkSession, folder: str, decoder: Callable[[bytes], dict | list[Callable[[], dict]]], glob: str = "*.pdf", most: int | None = None) -> DataFrame:
    """doc_id, lines, rows, failures, pages, error of the files of a folder, decoded by executors a file at a time.

    decoder: a file's bytes to {"lines": [...], "tables": [...]}, dicts with the names of LINE and ROW; or to a list of functions, one for each page, that give
    the like for their page, with or without its number. Of those the first `most` are called, and a page that fails is an entry of failures beside the pages that don't.
    A file that it can't read gives an error in place of all, and the others go on. pages: how many the file has, null if the decoder doesn't say.
    """
    kinds = (pa.list_(struct_of(StructType.fromDDL(LINE))), pa.list_(struct_of(StructType.fromDDL(ROW))), pa.list_(struct_of(StructType.fromDDL(FAILURE))), pa.int32(), pa.string())
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    named = files.select(document_id(F.element_at(F.split("path", "/"), -1), F.sha2("content", 256)).alias("doc_id"), "content")

    def by_page(pages: list[Callable[[], dict]]) -> list:
        lines, rows, failures = [], [], []
        for n, page in enumerate(pages[:most], 1):
            try:
                got = page()
                made = [[{"page_no": n} | x for x in got.get(name, [])] for name in ("lines", "tables")]
                pa.array(made[0], kinds[0].value_type), pa.array(made[1], kinds[1].value_type)  # of the right types, or this page fails
            except Exception as error:  # one page must not lose the others
                failures.append({"page_no": n, "error": f"{type(error).__name__}: {error}"})
            else:
                lines, rows = lines + made[0], rows + made[1]
        return [lines, rows, failures, len(pages), None]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                try:
                    got = decoder(batch.column("content")[i].as_py())
                    out = by_page(got) if isinstance(got, list) else [got.get("lines", []), got.get("tables", []), [], None, None]
                except Exception as error:  # one unreadable file must not lose the others
                    out = [None, None, None, None, f"{type(error).__name__}: {error}"]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 1), *(pa.array([x], t) for x, t in zip(out, kinds, strict=True))], ["doc_id", "lines", "rows", "failures", "pages", "error"])

    return named.mapInArrow(run, f"doc_id string, lines array<struct<{LINE}>>, rows array<struct<{ROW}>>, failures array<struct<{FAILURE}>>, pages int, error string")


def struct_of(fields: StructType) -> pa.DataType:
    kinds = {"int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    return pa.struct([(f.name, kinds[f.dataType.simpleString()]) for f in fields])


def decoded_lines(files: DataFrame) -> DataFrame:
    """Lines of decoded files, their text without control characters, as ingestion takes them."""
    return files.select("doc_id", F.explode("lines").alias("l")).select("doc_id", "l.*").withColumn("text", cleaned(F.col("text")))


def decoded_tables(files: DataFrame) -> DataFrame:
    return files.select("doc_id", F.explode("rows").alias("r")).select("doc_id", "r.*")


def fresh_uploads(uploads: DataFrame, documents: DataFrame) -> DataFrame:
    """One upload of each fingerprint that no document has: the first by name."""
    first = uploads.groupBy("sha256").agg(F.min("filename").alias("filename"))
    return first.join(documents.select("sha256"), "sha256", "left_anti")
