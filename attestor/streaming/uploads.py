"""Uploads as a stream: new files of a folder are scanned once and handed to a callback in batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attestor.sources.files import document_id
from attestor.sources.scratch import stored

FILE = "path string, modificationTime timestamp, length long, content binary"


def upload_stream(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """A stream of doc_id, filename, sha256, content of new files. It holds no state but the names of files."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", glob).load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.sha2("content", 256).alias("sha256"), "content")
    return named.select(document_id(F.col("filename"), F.col("sha256")).alias("doc_id"), "filename", "sha256", "content")


def process_uploads(stream: DataFrame, handle: Callable[[DataFrame], None], checkpoint: str, known: Callable[[], DataFrame] | None = None) -> StreamingQuery:
    """Run `handle` on each batch of what has arrived, then stop; a fingerprint comes once, however often it is uploaded. The checkpoint makes a restart skip what was handled.

    known: gives the documents (sha256) that were handled; if not given, a table of their fingerprints beside the checkpoint. It is looked up for each batch, so
    no state grows with the uploads. A batch that fails between `handle` and the table's entry is handled again.
    """
    ledger = f"{checkpoint.rstrip('/')}-handled"

    def handled(spark: SparkSession) -> DataFrame:
        try:
            return known() if known else spark.read.parquet(ledger)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], "sha256 string")

    def run(batch: DataFrame, _: int) -> None:
        first = batch.groupBy("sha256").agg(F.min("filename").alias("filename"))
        fresh = first.join(handled(batch.sparkSession).select("sha256"), "sha256", "left_anti")
        rows = stored(batch.join(fresh, ["sha256", "filename"], "left_semi").dropDuplicates(["sha256"]), "uploads")
        if rows.isEmpty():
            return
        handle(rows)
        if not known:
            rows.select("sha256").write.mode("append").parquet(ledger)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
