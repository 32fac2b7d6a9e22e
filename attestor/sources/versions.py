"""Tables in versions: a change of several tables is seen as a whole or not at all, and deletes are carried along the keys.

A table's rows lie in a fixed number of buckets by the hash of a key, each in one or more folders of Parquet files that nothing writes to
again. A version is a manifest, one small file that names each bucket's folders. A change writes new folders, of the buckets that it touches only, and becomes
visible when its manifest is renamed to the next version's name. Readers keep the folders of the version that they
opened. Of two changes that started from one version the second to end fails and can be tried again. What a failed change wrote is
named by no manifest, and vacuum() deletes it.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from attestor.sources.scratch import stored

BUCKETS = 64
#: Folders that a bucket may have before a change that adds to it puts them together.
MOST_FOLDERS = 8


class Conflict(RuntimeError):
    """Another change was committed since this one began."""


class Link(NamedTuple):
    """child.column refers to parent.key; when a parent row goes, its child rows go or, with keep, lose the reference."""

    child: str
    column: str
    parent: str
    key: str
    keep: bool = False


class Table(NamedTuple):
    """A table's primary key, and the column whose hash deals its rows to buckets."""

    key: str
    bucket_by: str


#: The stored tables, parents before children, and their links.
TABLES = {
    "documents": Table("doc_id", "doc_id"),
    "pages": Table("page_id", "doc_id"),
    "chunks": Table("chunk_id", "doc_id"),
    "facts_raw": Table("fact_id", "doc_id"),
    "facts": Table("fact_id", "entity_id"),
    "relations": Table("relation_id", "entity_id"),
    "subjects": Table("phrase", "phrase"),
    "families": Table("phrase", "phrase"),
    "entities": Table("entity_id", "entity_id"),
    "attribute_families": Table("family_id", "family_id"),
    "year_end": Table("month", "month"),
}
LINKS = (
    Link("pages", "doc_id", "documents", "doc_id"),
    Link("chunks", "doc_id", "documents", "doc_id"),
    Link("facts_raw", "doc_id", "documents", "doc_id"),
    Link("facts_raw", "chunk_id", "chunks", "chunk_id"),
    Link("facts", "doc_id", "documents", "doc_id"),
    Link("facts", "chunk_id", "chunks", "chunk_id"),
    Link("relations", "fact_a", "facts", "fact_id"),
    Link("relations", "fact_b", "facts", "fact_id"),
    Link("relations", "bridging_fact_id", "facts", "fact_id", keep=True),
)


def bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


class Versions:
    """The versions of the tables below a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.jvm = spark._jvm
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.files = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def listed(self, name: str) -> list[str]:
        """Names in a folder; none if there is no such folder."""
        at = self.path(name)
        return sorted(s.getPath().getName() for s in self.files.listStatus(at)) if self.files.exists(at) else []

    def latest(self) -> int:
        """The number of the newest version; 0 before the first."""
        return max((int(n[: -len(".json")]) for n in self.listed("_versions") if n.endswith(".json")), default=0)

    def manifest(self, version: int) -> dict:
        if version == 0:
            return {}
        stream = self.files.open(self.path(f"_versions/{version:010d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def at(self, version: int | None = None) -> Snapshot:
        """The tables as of a version, the newest if none is given."""
        return Snapshot(self, self.latest() if version is None else version)

    def change(self) -> Change:
        return Change(self, self.latest())

    def publish(self, version: int, manifest: dict) -> None:
        """Make a manifest the version's, by one rename that fails if the version exists."""
        own = f"_versions/.{uuid.uuid4().hex}"
        out = self.files.create(self.path(own), False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        none = self.spark.sparkContext._gateway.new_array(options, 1)
        none[0] = options.NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), self.conf)
        try:
            context.rename(self.path(own), self.path(f"_versions/{version:010d}.json"), none)
        except Exception as error:
            self.files.delete(self.path(own), False)
            if self.files.exists(self.path(f"_versions/{version:010d}.json")):
                raise Conflict(f"version {version} was committed meanwhile") from error
            raise

    def vacuum(self, keep: int = 1) -> int:
        """Delete the folders that none of the newest `keep` versions name, and older manifests; the count of folders. No change may be under way."""
        newest = self.latest()
        kept = {folder for v in range(max(1, newest - keep + 1), newest + 1) for t in self.manifest(v).values() for folders in t["buckets"].values() for folder in folders}
        gone = 0
        for name in self.listed(""):
            for written in self.listed(name) if name != "_versions" else []:
                for part in self.listed(f"{name}/{written}"):
                    if f"{name}/{written}/{part}" not in kept:
                        gone += bool(part.startswith("_bucket="))
                        self.files.delete(self.path(f"{name}/{written}/{part}"), True)
                if not self.listed(f"{name}/{written}"):
                    self.files.delete(self.path(f"{name}/{written}"), True)
        for n in self.listed("_versions"):
            if n.startswith(".") or n.endswith(".json") and int(n[: -len(".json")]) <= newest - keep:
                self.files.delete(self.path(f"_versions/{n}"), False)
        return gone


class Snapshot:
    """The tables of one version."""

    def __init__(self, versions: Versions, version: int):
        self.versions, self.version, self.tables = versions, version, versions.manifest(version)

    def names(self) -> list[str]:
        return list(self.tables)

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or its rows in some buckets."""
        spark, table = self.versions.spark, self.tables[name]
        schema = StructType.fromJson(table["schema"])
        wanted = table["buckets"] if buckets is None else {str(b) for b in buckets} & set(table["buckets"])
        folders = [f"{self.versions.folder}/{f}" for b in sorted(wanted, key=int) for f in table["buckets"][b]]
        return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


class Change(Snapshot):
    """Changes of tables that become the next version together. read() shows them already."""

    def written(self, name: str, rows: DataFrame) -> dict[str, str]:
        """Write rows to new folders, one for each bucket that has any: bucket to folder. Large buckets are written by several tasks."""
        folder = f"{name}/{uuid.uuid4().hex}"
        dealt = rows.withColumn("_bucket", bucket(TABLES[name].bucket_by)).hint("rebalance", "_bucket")
        dealt.write.partitionBy("_bucket").parquet(f"{self.versions.folder}/{folder}")
        return {part.removeprefix("_bucket="): f"{folder}/{part}" for part in self.versions.listed(folder) if part.startswith("_bucket=")}

    def replace(self, name: str, rows: DataFrame) -> None:
        """The table has these rows and no others."""
        made = self.written(name, rows)
        self.tables[name] = {"schema": rows.schema.jsonValue(), "buckets": {b: [f] for b, f in made.items()}}

    def rewrite(self, name: str, buckets: list[int], rows: DataFrame) -> None:
        """These buckets have these rows and no others."""
        made = self.written(name, rows.select(*(f["name"] for f in self.tables[name]["schema"]["fields"])))
        left = {b: f for b, f in self.tables[name]["buckets"].items() if int(b) not in set(buckets)}
        self.tables[name]["buckets"] = left | {b: [f] for b, f in made.items()}

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows. What the table has is not rewritten, save for buckets that came to many folders."""
        if name not in self.tables:
            return self.replace(name, rows)
        have = self.tables[name]["buckets"]
        for b, f in self.written(name, rows.select(*(f["name"] for f in self.tables[name]["schema"]["fields"]))).items():
            have[b] = [*have.get(b, []), f]
        many = [int(b) for b, folders in have.items() if len(folders) > MOST_FOLDERS]
        if many:
            self.rewrite(name, many, self.read(name, many))

    def touched(self, name: str, keys: DataFrame) -> list[int]:
        """Buckets of the rows whose bucket key is among keys (one column): at most BUCKETS numbers."""
        return [r.b for r in keys.select(bucket(keys.columns[0]).alias("b")).distinct().collect()]

    def delete(self, name: str, keys: DataFrame) -> dict[str, DataFrame]:
        """Delete the rows with these primary keys (one column) and what refers to them, down the links: the deleted rows' keys by table.

        Of a child only the key columns are read to find what goes, and only buckets that lose a row are written again.
        """
        gone = {name: stored(keys.toDF(TABLES[name].key).distinct(), "gone")}
        if name in self.tables:
            table = TABLES[name]
            mine = self.read(name).select(*{table.key, table.bucket_by}).join(gone[name], table.key, "left_semi")
            buckets = self.touched(name, mine.select(table.bucket_by))
            self.rewrite(name, buckets, self.read(name, buckets).join(gone[name], table.key, "left_anti"))
        for child, table in TABLES.items():
            links = [link for link in LINKS if link.child == child and link.parent in gone]
            if child not in self.tables or not links:
                continue
            thin = self.read(child).select(*{table.key, table.bucket_by, *(link.column for link in links)})
            own = [table.key, F.col(table.bucket_by).alias("_by")]
            refers = lambda link: thin.join(gone[link.parent].select(F.col(link.key).alias(link.column)), link.column, "left_semi").select(*own)  # noqa: E731, B023
            ends = [refers(link) for link in links if not link.keep]
            loose = [link for link in links if link.keep]
            hit = ends[0]
            for more in ends[1:]:
                hit = hit.union(more)
            hit = stored(hit.distinct(), "gone")
            gone[child] = hit.select(table.key)
            changed = hit.select("_by")
            for link in loose:
                changed = changed.union(refers(link).select("_by"))
            buckets = self.touched(child, changed)
            rows = self.read(child, buckets).join(gone[child], table.key, "left_anti")
            for link in loose:
                lost = gone[link.parent].select(F.col(link.key).alias("_lost"))
                rows = rows.join(lost, rows[link.column] == lost["_lost"], "left").withColumn(link.column, F.when(F.col("_lost").isNull(), F.col(link.column))).drop("_lost")
            self.rewrite(child, buckets, rows)
        return gone

    def commit(self) -> int:
        """Make the changes the next version: its number. Raises Conflict if another change did so first."""
        self.versions.publish(self.version + 1, self.tables)
        return self.version + 1
