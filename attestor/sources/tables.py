"""Tables in Parquet: append with conflicts skipped, replacement by document, updates, and audits of what no constraint enforces."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_rows(rows: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't taken; of rows with one key among themselves the smallest stays."""
    order = F.struct(*[c for c in rows.columns if c not in keys]) if len(rows.columns) > len(keys) else F.struct(*keys)
    one = rows.groupBy(*keys).agg(F.min(order).alias("_r"))
    kept = one.select(*keys, "_r.*") if len(rows.columns) > len(keys) else one.select(*keys)
    return kept.select(*rows.columns).join(existing.select(*keys), keys, "left_anti")


def append(rows: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Append to a table; with keys, rows that conflict with stored ones are skipped."""
    if keys:
        rows = new_rows(rows, rows.sparkSession.read.parquet(path), keys)
    rows.write.mode("append").parquet(path)


def replaced(existing: DataFrame, rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """existing with all rows of the keys in `rows` replaced by those."""
    return existing.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def replace_documents(rows: DataFrame, path: str, key: str = "doc_id") -> None:
    """Overwrite only the partitions of the documents in `rows`."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def updated(existing: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """existing with the non-null values of changes (key and some of its columns)."""
    names = [c for c in changes.columns if c != key]
    new = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in names))
    joined = existing.join(new, key, "left")
    return joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in names else c for c in existing.columns))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of child rows without a parent."""
    return child.select(*keys).distinct().join(parent.select(*keys), keys, "left_anti")


def check_columns(rows: DataFrame, expected: list[str]) -> DataFrame:
    """rows with exactly the expected columns in their order; raises ValueError if any is missing or unknown."""
    if set(rows.columns) != set(expected):
        raise ValueError(f"columns {sorted(rows.columns)} are not {sorted(expected)}")
    return rows.select(*expected)


#: What a statement consists of: comments, quoted parts (with doubled or escaped quotes inside), semicolons, and the rest.
PIECE = re.compile(r"""--[^\n]*|/\*.*?(?:\*/|\Z)|'(?:[^'\\]|\\.|'')*(?:'|\Z)|"(?:[^"\\]|\\.|"")*(?:"|\Z)|`(?:[^`]|``)*(?:`|\Z)|;|[^-/'"`;]+|.""", re.S)


def statements(script: str) -> list[str]:
    """The statements of a script, parted by semicolons outside of quotes and comments; comments go."""
    out = [""]
    for piece in PIECE.findall(script):
        if piece == ";":
            out.append("")
        else:
            out[-1] += " " if piece.startswith(("--", "/*")) else piece
    return [s.strip() for s in out if s.strip()]


def run_script(spark: SparkSession, script: str) -> None:
    """Run the statements of a script."""
    for statement in statements(script):
        spark.sql(statement)


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """name, files, bytes of the tables that a folder holds."""
    parts = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder).select("path", "length")
    name = F.regexp_extract(F.col("path"), "/([^/]+)/(?:[^/]+=[^/]*/)*[^/]+$", 1)
    return parts.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def missing_tables(spark: SparkSession, folder: str, expected: list[str]) -> list[str]:
    """Names of expected tables that the folder lacks."""
    there = {r.name for r in catalog(spark, folder).select("name").collect()}
    return [n for n in expected if n not in there]


def sampled(df: DataFrame, k: int, key: str, seed: int = 0) -> DataFrame:
    """k rows at random, the same in every run with one seed: those whose key hashes lowest."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(k)


def table_counts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """name, n of stored tables."""
    counted = [spark.read.parquet(p).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n, p in paths.items()]
    out = counted[0]
    for df in counted[1:]:
        out = out.union(df)
    return out
