"""A corpus that grows by uploads: documents are added or replaced, and only what they touch is paired and judged again.

The stages of single documents run for the uploaded ones alone. Names of entities and families and the end of the financial year depend on all facts: they are
counted again from the columns that they need, and facts whose name came out different count as changed. Changed facts, old and new, name the buckets (entity,
family) that they touch; those are paired and judged again. A proof by a third fact may come from any family of
an entity, so open gaps of touched entities are searched again as well. All tables of an upload become one version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions.text import readable_id
from attestor.operators import adjudication, resolution
from attestor.operators.pairing import BUCKET_CAP, KEYS
from attestor.plans import prompts
from attestor.plans.pipeline import Run
from attestor.plans.settings import Settings
from attestor.sources.scratch import stored
from attestor.sources.versions import Change, Versions

#: Leaves that a third fact may turn into a proof, or that one has.
OPEN = ("R13", "R14", "R15")
RELATION = ("relation_id", "fact_a", "fact_b", *KEYS, "doc_a", "doc_b", "leaf", "verdict", "method", "explanation", "bridging_fact_id")


def judged(facts: DataFrame, cap: int | None = BUCKET_CAP, candidates: DataFrame | None = None, among: DataFrame | None = None) -> DataFrame:
    """Relations as the corpus stores them: verdict, reason and bucket of every pair of the facts, or of the candidates.

    All but a proof by a third fact is written where the pair is judged, beside its facts; only proofs look theirs up.
    """
    docs = {f"doc_{x}": F.col(f"{x}.doc_id") for x in ("a", "b")}
    rows = adjudication.verdicts(facts, cap, candidates, among, {"explanation": adjudication.reason()} | {k: F.col(k) for k in KEYS} | docs)
    proofs = adjudication.explained(rows.where("bridging_fact_id IS NOT NULL"), facts if among is None else among)
    proofs = proofs.withColumns({k: F.coalesce(f"a.{k}", f"b.{k}") for k in KEYS} | docs)
    return rows.where("bridging_fact_id IS NULL").select(*RELATION).unionByName(proofs.select(*RELATION))


def delta(change: Change, fresh: DataFrame, gone: DataFrame, cap: int | None = BUCKET_CAP) -> dict[str, list[int]]:
    """Bring facts and relations up to date: fresh facts take the place of stored ones with their fact_id, gone ones (fact_id, entity_id, attribute_family as stored) go.

    A fact that changed its bucket is in both. Facts and relations are read and written by buckets of entities, those of touched entities only;
    gives the numbers of the buckets that were.
    """
    fresh, gone = stored(fresh, "fresh"), stored(gone.select("fact_id", *KEYS), "gone")
    touched = stored(fresh.select(*KEYS).union(gone.select(*KEYS)).where("entity_id IS NOT NULL").distinct(), "touched")
    entities = touched.select("entity_id").distinct()
    buckets = change.touched("facts", fresh.select("entity_id").union(gone.select("entity_id")))
    out = fresh.select("fact_id").union(gone.select("fact_id")).distinct()
    facts = stored(change.read("facts", buckets).join(out, "fact_id", "left_anti").unionByName(fresh), "facts")
    change.rewrite("facts", buckets, facts)
    own = stored(facts.join(entities, "entity_id", "left_semi"), "own")
    relations = change.read("relations", buckets)
    apart = relations.join(touched, KEYS, "left_anti")
    reopened = apart.where(F.col("leaf").isin(*OPEN)).join(entities, "entity_id", "left_semi").select("relation_id", "fact_a", "fact_b")
    again = judged(own, cap, stored(reopened, "reopened"))
    same = apart.join(again.select("relation_id"), "relation_id", "left_anti")
    made = judged(own.join(touched, KEYS, "left_semi"), cap, among=own)
    change.rewrite("relations", buckets, reduce(DataFrame.unionByName, (same, again, made)))
    return {"facts": buckets, "relations": buckets}


def named(valued: DataFrame, subjects: DataFrame, families: DataFrame) -> DataFrame:
    """Facts (with subject and phrase) with entity_id and attribute_family; subjects: phrase, leader; families: phrase, label."""
    leaders = subjects.select(F.col("phrase").alias("subject"), readable_id("ent", F.col("leader")).alias("entity_id"))
    labels = families.select("phrase", readable_id("fam", F.col("label")).alias("attribute_family"))
    return valued.join(leaders, "subject").join(labels, "phrase")


def changed(old: DataFrame, new: DataFrame, value: str) -> DataFrame:
    """phrase of those that both maps have with different values."""
    return old.join(new.select("phrase", F.col(value).alias("_new")), "phrase").where(F.col(value) != F.col("_new")).select("phrase")


class Corpus:
    """The versions of a corpus below a folder. provider: prompt to answer, None for a corpus without a model."""

    def __init__(self, spark: SparkSession, folder: str, provider: Callable[[str], str] | None = None, settings: Settings | None = None):
        self.spark, self.folder, self.provider = spark, folder.rstrip("/"), provider
        self.settings = settings or Settings.of(spark)
        self.store = Versions(spark, f"{self.folder}/tables")

    def run(self) -> Run:
        return Run(self.spark, f"{self.folder}/uploads/{uuid.uuid4().hex}", self.provider, self.settings, f"{self.folder}/cache")

    def upload(self, lines: DataFrame, tables: DataFrame) -> int:
        """Take in documents by their lines and raw tables: the number of the version that has them. A document that the corpus has is replaced with all that came of it."""
        run = self.run()
        run.ingest(lines, tables)
        run.cut()
        run.extract()
        return self.add(run.read("pages"), run.read("chunks"), run.ground().where("grounded"))

    def add(self, pages: DataFrame, chunks: DataFrame, facts: DataFrame) -> int:
        """Take in documents by their pages, passages and grounded claims."""
        change = self.store.change()
        docs = stored(pages.select("doc_id").distinct(), "docs")
        resolved = resolution.resolved_subjects(facts).withColumn("phrase", resolution.simple_attribute(F.col("attribute_raw")))
        raw = stored(resolved, "raw")
        gone = self.removed(change, docs)
        for name, rows in (("documents", docs), ("pages", pages.withColumn("page_id", F.concat_ws("__", "doc_id", "page_no"))), ("chunks", chunks), ("facts_raw", raw)):
            change.append(name, rows)
        self.settle(change, raw, gone)
        return change.commit()

    def remove(self, docs: DataFrame) -> int:
        """Delete documents (doc_id) with all that came of them."""
        change = self.store.change()
        gone = self.removed(change, docs)
        self.settle(change, change.read("facts_raw").limit(0), gone)
        return change.commit()

    def removed(self, change: Change, docs: DataFrame) -> DataFrame | None:
        """Delete documents from a change: the facts that went with their buckets, None in an empty corpus."""
        if "facts" not in change.tables:
            return None
        gone = stored(change.read("facts").select("fact_id", "doc_id", *KEYS).join(docs, "doc_id", "left_semi").drop("doc_id"), "gone")
        change.delete("documents", docs)
        return gone

    def settle(self, change: Change, fresh: DataFrame, gone: DataFrame | None) -> None:
        """Names, facts and relations of a change whose raw facts are complete; fresh: those that are new."""
        raw = change.read("facts_raw")
        old = {n: change.read(n) for n in ("subjects", "families", "year_end") if n in change.tables}
        maps = {n: stored(df, n) for n, df in self.maps(raw).items()}
        moved = fresh
        if old and gone is not None:
            if old["year_end"].exceptAll(maps["year_end"]).isEmpty():
                other_subject = changed(old["subjects"], maps["subjects"], "leader").withColumnRenamed("phrase", "subject")
                other_family = changed(old["families"], maps["families"], "label")
                known = raw.join(fresh.select("fact_id"), "fact_id", "left_anti")
                for names, on in ((other_subject, "subject"), (other_family, "phrase")):
                    if not stored(names, "renamed").isEmpty():
                        moved = moved.unionByName(known.join(names, on, "left_semi"))
                moved = moved.dropDuplicates(["fact_id"])
            else:
                moved = raw
            ids = moved.join(fresh.select("fact_id"), "fact_id", "left_anti")
            gone = gone.union(named(ids, old["subjects"], old["families"]).select("fact_id", *KEYS))
        for n, df in maps.items():
            change.replace(n, df)
        valued = resolution.normalised(moved, maps["year_end"]).withColumn("scope_tags", resolution.scope_tags(F.col("scope_raw")))
        facts = named(valued, maps["subjects"], maps["families"])
        if gone is None:
            facts = stored(facts, "facts")
            change.replace("facts", facts)
            change.replace("relations", judged(facts, self.settings.bucket_cap))
        else:
            delta(change, facts.select(*change.read("facts").columns), gone, self.settings.bucket_cap)

    def maps(self, raw: DataFrame) -> dict[str, DataFrame]:
        """subjects, families and year_end as all facts have them, and the entities and families that they make."""
        subjects = stored(resolution.entity_leaders(raw).select("phrase", "leader"), "subjects")
        leaders = stored(resolution.family_leaders(raw).select("phrase", F.col("leader").alias("label")), "leaders")
        groups = None
        if self.provider is not None:
            sizes = raw.select("phrase").join(leaders, "phrase").groupBy("label").agg(F.count(F.lit(1)).alias("n_facts"))
            run = self.run()
            asked = run.write(run.ask(prompts.merge_prompt(run.write(sizes, "family_sizes"))), "answered_families")
            run.fail("normalise", asked.where("error IS NOT NULL").select(F.lit("family_merge_failed"), "request_id", "error"))
            groups = prompts.merge_groups(asked)
        sizes = raw.select("phrase").join(leaders, "phrase").groupBy("label").agg(F.count(F.lit(1)).alias("n_facts"))
        families = stored(leaders.join(resolution.semantic_merge(sizes, groups), "label").select("phrase", F.col("final_label").alias("label")), "families")
        entities = resolution.entities(raw.join(subjects.select(F.col("phrase").alias("subject"), "leader"), "subject"))
        return {"subjects": subjects, "families": families, "year_end": resolution.learn_year_end(raw), "entities": entities, "attribute_families": resolution.family_rows(families)}

    def relations(self, version: int | None = None) -> DataFrame:
        """Relations of a version with what no rule settles settled: by the model for the first `model_pairs` of them, where there is one."""
        at = self.store.at(version)
        rows = at.read("relations").withColumns({x: F.when(F.col(f"doc_{x}").isNotNull(), F.struct(F.col(f"doc_{x}").alias("doc_id"))) for x in ("a", "b")})
        answers = None
        if self.provider is not None:
            first = stored(adjudication.asked_first(rows, self.settings.model_pairs).select("relation_id"), "asked")
            asked = rows.drop("a", "b").join(F.broadcast(first), "relation_id", "left_semi")
            run = self.run()
            said = run.write(run.ask(prompts.adjudication_prompts(adjudication.with_facts(asked, at.read("facts")), self.settings.model_pairs)), "answered_pairs")
            answers = prompts.adjudication_answers(said.where("answer IS NOT NULL"))
        return adjudication.settled(rows, answers, self.settings.model_pairs).select(*RELATION)
