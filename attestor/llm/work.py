"""Scratch tables in the folder that the cluster shares between executors."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of 64 bits of a membership filter: its broadcast never has more rows than this.
FILTER_WORDS = 1 << 20
#: Rows that a worker is handed at once.
BATCH_ROWS = 1024


def folder(spark: SparkSession, name: str) -> str:
    """A new, unique folder path below spark.checkpoint.dir, which is deleted when the application ends.

    Where that is unset, a temporary one in local mode and an error on a cluster.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}"
    own = f"{root.rstrip('/')}/attestor-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(own)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Have the session hand workers few rows at a time, where it was left at Spark's default: texts may be long, and both sides hold whole batches."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def pieces(batches, rows: int = 256):
    """Arrow batches in slices of few rows, so that a worker holds few texts at a time as Python objects. At the end what was freed goes back to the system."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def filter_of(members: DataFrame, column: str) -> DataFrame:
    """A filter of 64 * FILTER_WORDS bits over a 64-bit hash column: word, bits."""
    word, bit = F.pmod(column, F.lit(FILTER_WORDS)).cast("int"), f"shiftleft(1L, CAST(shiftrightunsigned(`{column}`, 58) AS INT))"
    return members.select(word.alias("_word"), F.expr(bit).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))


def probed(df: DataFrame, column: str, members: DataFrame, how: str) -> DataFrame:
    word = F.pmod(df[column], F.lit(FILTER_WORDS)).cast("int")
    hit = F.expr(f"(shiftrightunsigned(_bits, CAST(shiftrightunsigned(`{column}`, 58) AS INT)) & 1L) = 1")
    return df.join(F.broadcast(filter_of(members, column)), (word == F.col("_word")) & hit, how)


def passing(df: DataFrame, column: str, members: DataFrame) -> DataFrame:
    """Rows of df whose hash may be among members' (a one-hash Bloom filter: no member is lost, some others stay).

    The broadcast side holds at most FILTER_WORDS rows of twelve bytes, whatever the size of the input. Beyond some ten
    million members more and more others stay: that costs work, never a row.
    """
    return probed(df, column, members, "left_semi")


def whole(df: DataFrame) -> Column:
    """All columns of df as one struct, whatever their names."""
    return F.struct(*("`" + c.replace("`", "``") + "`" for c in df.columns))


def without(df: DataFrame, hashed: Column, gone: DataFrame, column: str) -> DataFrame:
    """Rows of df whose hash isn't among gone's column of hashes; all columns. Only rows that pass the filter of gone are moved."""
    packed = df.select(whole(df).alias("row"), hashed.alias(column))
    left = probed(packed, column, gone, "left_anti").select("row")
    return left.union(passing(packed, column, gone).join(gone.select(column).distinct(), column, "left_anti").select("row")).select("row.*")
