"""The seven stages over stored tables: pages, passages, claims, evidence, values and entities, pairs, verdicts.

Each stage reads the tables of those before it and writes its own as Parquet, so a run can stop and go on
anywhere and a lost executor costs a stage's tasks, not the run.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions.text import readable_id
from attestor.operators import adjudication, extraction, grounding, layout, model_calls, pairing, passages, resolution
from attestor.plans import prompts
from attestor.plans.settings import Settings
from attestor.sources import files
from attestor.sources import tables as tables_


class Run:
    """A run below a folder. provider: prompt to answer, None for a run without a model."""

    def __init__(self, spark: SparkSession, folder: str, provider: Callable[[str], str] | None = None, settings: Settings | None = None, cache: str | None = None):
        """cache: the folder of answers that runs share, else the run's own."""
        self.spark, self.folder, self.provider = spark, folder.rstrip("/"), provider
        self.settings = settings or Settings.of(spark)
        self.cached = cache or f"{self.folder}/cache"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.read(name)

    def ingest(self, lines: DataFrame, tables: DataFrame) -> DataFrame:
        most = self.settings.max_pages
        keep = (lambda df: df.where(F.col("page_no") <= most)) if most else lambda df: df
        made = self.write(layout.ingested(keep(lines), keep(tables)), "pages")
        lost = layout.lost_lines(layout.ordered(keep(lines)), made)
        self.fail("ingest", lost.select(F.lit("line_not_on_its_page").alias("kind"), "line_id", "text"))
        return made

    def ingest_files(self, folder: str, decoder: Callable[[bytes], dict], glob: str = "*.pdf") -> DataFrame:
        """Ingestion of a folder's files through a decoder; files and pages that it can't read go to failures."""
        files_ = self.write(files.decoded(self.spark, folder, decoder, glob, self.settings.max_pages), "decoded")
        made = self.ingest(files.decoded_lines(files_), files.decoded_tables(files_))
        lost = files_.where("error IS NOT NULL").select(F.lit("file_not_decoded").alias("kind"), "doc_id", "error")
        pages = files_.select("doc_id", F.explode("failures").alias("f")).select(F.lit("page_not_decoded"), F.concat_ws(" page ", "doc_id", F.col("f.page_no").cast("string")), "f.error")
        self.fail("decode", lost.union(pages))
        return made

    def fail(self, stage: str, rows: DataFrame) -> None:
        """Write a stage's failures: rows of kind, subject and detail."""
        self.write(rows.toDF("kind", "subject", "detail").select(F.lit(stage).alias("stage"), "kind", "subject", F.substring("detail", 1, 1500).alias("detail")), f"failures_{stage}")

    def failures(self) -> DataFrame:
        """All failures of a run: stage, kind, subject, detail."""
        names = [n for n in (r.name for r in tables_.catalog(self.spark, self.folder).collect()) if n.startswith("failures_")]
        empty = self.spark.createDataFrame([], "stage string, kind string, subject string, detail string")
        return reduce(DataFrame.unionByName, (self.read(n) for n in names), empty)

    def ask(self, prompts: DataFrame) -> DataFrame:
        """request_id, answer, error of prompts (request_id, doc_id, prompt), from the cache where it has them.

        The rest is asked in rounds, equal prompts once, and each round's answers are in the cache before the next, so a run that is cut off
        asks nothing twice. With a provider every request has an answer or an error.
        """
        s = self.settings
        keyed = prompts.withColumn("key", extraction.cache_key(F.lit(s.prompt_version), F.lit(s.model), F.col("prompt")))
        errors = self.spark.createDataFrame([], "key string, error string")
        if self.provider is not None:
            first = extraction.cache_misses(keyed, self.cache()).groupBy("key").agg(F.min(F.struct("request_id", "doc_id", "prompt")).alias("r"))
            misses = self.write(first.select("key", "r.*"), "misses")
            rounds = max(1, -(-misses.count() // s.requests_per_round))
            self.write(misses.limit(0).selectExpr("request_id", "key", "CAST(NULL AS STRING) AS answer", "CAST(NULL AS STRING) AS error"), "answers")
            for n in range(rounds):
                part = misses.where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == n)
                asked = model_calls.paced(part, self.provider, s.requests_per_minute, s.request_tasks)
                asked.join(part.select("request_id", "key"), "request_id").select("request_id", "key", "answer", "error").write.mode("append").parquet(f"{self.folder}/answers")
                got = self.read("answers").join(part.select("key"), "key", "left_semi")
                got.where("answer IS NOT NULL").select("key", "answer").write.mode("append").parquet(self.cached)
            errors = self.read("answers").where("error IS NOT NULL").select("key", "error")
        known = self.cache().groupBy("key").agg(F.min("answer").alias("answer"))
        return keyed.select("request_id", "doc_id", "key").join(known, "key", "left").join(errors, "key", "left").drop("key")

    def cache(self) -> DataFrame:
        try:
            return self.spark.read.parquet(self.cached)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], "key string, answer string")

    def cut(self) -> DataFrame:
        made = self.write(passages.chunks(self.read("pages")), "chunks")
        self.fail("chunk", made.where("why_skipped IS NOT NULL").select(F.lit("skipped_by_prefilter"), "chunk_id", "why_skipped"))
        return made

    def prompts(self, document: str | None = None) -> DataFrame:
        """The requests of a run, those of one document only if its text is given: what a dry run shows."""
        chunk = self.read("chunks")
        if document:
            chunk = chunk.where(F.col("doc_id").ilike(f"%{document}%"))
        requests = extraction.packed(chunk)
        if self.settings.max_requests is not None:
            requests = requests.orderBy("request_id").limit(self.settings.max_requests)
        self.write(requests, "requests")
        return extraction.prompts(self.read("requests"), chunk, self.settings.instructions)

    def extract(self, document: str | None = None) -> DataFrame:
        """Ask for what the cache lacks, then read all answers into facts; what fails or is dropped goes to failures."""
        asked = self.write(self.prompts(document), "prompts")
        answered = self.write(self.ask(asked), "answered")
        claims = self.write(extraction.parsed(answered.where("answer IS NOT NULL").drop("error")), "claims")
        invalid = claims.where("complaint IS NOT NULL").select(F.lit("invalid_claim"), "request_id", "complaint")
        foreign = extraction.misattributed(claims, self.read("requests")).select(F.lit("passage_not_in_request"), "request_id", "chunk_id")
        failed = answered.where("error IS NOT NULL").select(F.lit("model_call_failed"), "request_id", "error")
        self.fail("extract", invalid.union(foreign).union(failed))
        return self.write(extraction.attributed(claims, self.read("requests"), self.read("chunks")), "facts_raw")

    def ground(self) -> DataFrame:
        sourced = grounding.with_sources(self.read("facts_raw").drop("grounded"), self.read("chunks"), self.read("pages"))
        checked = self.write(grounding.grounded(sourced).drop("chunk_text", "page_text", "chunk_char_start"), "facts_checked")
        self.fail("ground", grounding.rejections(checked).select("kind", "fact_id", "detail"))
        return checked

    def normalise(self, groups: DataFrame | None = None) -> DataFrame:
        """Values, entities and families of grounded facts; groups of family labels are given, else the provider is asked for them."""
        facts = self.read("facts_checked").where("grounded")
        valued = resolution.resolved_subjects(resolution.normalised(facts)).withColumn("phrase", resolution.simple_attribute(F.col("attribute_raw")))
        valued = self.write(valued.withColumn("scope_tags", resolution.scope_tags(F.col("scope_raw"))), "facts_valued")
        leaders = resolution.entity_leaders(valued).select(F.col("phrase").alias("subject"), "leader")
        named = valued.join(leaders, "subject")
        self.write(resolution.entities(named), "entities")
        families = resolution.family_leaders(valued).select("phrase", F.col("leader").alias("label"))
        sizes = valued.join(families, "phrase").groupBy("label").agg(F.count(F.lit(1)).alias("n_facts"))
        if groups is None and self.provider is not None:
            sizes = self.write(sizes, "family_sizes")
            merged = self.write(self.ask(prompts.merge_prompt(sizes)), "answered_families")
            self.fail("normalise", merged.where("error IS NOT NULL").select(F.lit("family_merge_failed"), "request_id", "error"))
            groups = prompts.merge_groups(merged)
        mapping = families.join(resolution.semantic_merge(sizes, groups), "label").select("phrase", F.col("final_label").alias("label"))
        self.write(resolution.family_rows(mapping), "attribute_families")
        full = named.join(mapping, "phrase").withColumns({"entity_id": readable_id("ent", F.col("leader")), "attribute_family": readable_id("fam", F.col("label"))})
        return self.write(full.drop("subject", "phrase", "leader", "label"), "facts")

    def pair(self) -> DataFrame:
        return self.write(pairing.candidates(self.read("facts"), self.settings.bucket_cap), "candidates")

    def adjudicate(self, answers: DataFrame | None = None) -> DataFrame:
        """Verdicts of the candidates that pair() wrote; answers on pairs that no rule settles are given, else the provider is asked for them."""
        candidates = self.read("candidates").select("relation_id", "fact_a", "fact_b")
        found = self.write(adjudication.adjudicated(self.read("facts"), candidates=candidates), "verdicts")
        if answers is None and self.provider is not None:
            said = self.write(self.ask(prompts.adjudication_prompts(found, self.settings.model_pairs)), "answered_pairs")
            answers = prompts.adjudication_answers(said.where("answer IS NOT NULL"))
            invalid = said.where("answer IS NOT NULL").join(answers.select(F.col("relation_id").alias("request_id")), "request_id", "left_anti")
            failed = said.where("error IS NOT NULL").select(F.lit("model_call_failed"), "request_id", "error")
            self.fail("adjudicate", failed.union(invalid.select(F.lit("no_known_verdict"), "request_id", "answer")))
        return self.write(adjudication.settled(found, answers, self.settings.model_pairs), "relations")

    def all(self, lines: DataFrame, tables: DataFrame) -> DataFrame:
        """Every stage; raises if no evidence holds or nothing can be compared, as later stages would then say nothing."""
        self.ingest(lines, tables)
        self.cut()
        self.extract()
        if self.ground().where("grounded").isEmpty():
            raise RuntimeError("no claim's evidence was found in its source")
        self.normalise()
        if self.pair().isEmpty():
            raise RuntimeError("no two facts can be compared")
        return self.adjudicate()
