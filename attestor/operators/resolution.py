"""Entities, attribute families and normalised values of facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions import parsing
from attestor.functions.similarity import sorted_tokens, token_sort_ratio_udf
from attestor.functions.text import plain, readable_id, words
from attestor.sources.scratch import stored

# Fixed values.
STOPWORDS = (
    "a", "an", "the", "of", "for", "and", "or", "to", "in", "on", "at", "by", "with", "from", "as", "is", "are", "was", "were", "be", "been", "this",
    "that", "these", "those", "it", "its", "our", "we", "us", "their", "which", "includes", "including", "included", "excludes", "excluding", "excluded",
    "period", "periods", "such", "any", "all", "other", "others", "per",
)
LEGAL_FORMS = (
    "limited", "ltd", "private", "pvt", "public", "plc", "incorporated", "inc", "corporation", "corp", "company", "co", "llp", "llc", "gmbh", "sa", "nv",
    "holdings", "holding", "group",
)
SELF_REFERENCES = (
    "company", "our company", "the company", "the companies", "issuer", "the issuer", "registrant", "the registrant", "group", "the group", "our group",
    "the corporation", "corporation", "we", "us", "our", "the firm", "firm", "the business", "business", "the organisation", "the organization",
)
MEASURES = (
    "cagr", "growth", "increase", "decrease", "decline", "change", "delta", "margin", "ratio", "rate", "percentage", "percent", "share", "proportion",
    "yoy", "qoq", "per", "average", "median", "total", "net", "gross", "adjusted", "reported", "estimated", "projected", "forecast",
)
IDENTIFIER = r"(?U)\b([A-Z]{2,6})\s*[:\-]?\s*([A-Z0-9]{6,25})\b"
NAME_SCORE = 93.0
ATTRIBUTE_SCORE = 88.0
LEADER_COUNT = 2
UNNAMED = "unnamed subject"
MERGE_LEAST_FACTS = 3
MERGE_MOST_LABELS = 260


def is_self_reference(name: Column) -> Column:
    return plain(name).isin(*SELF_REFERENCES)


def simple_name(name: Column) -> Column:
    """Plain words without legal forms, or all of them if nothing else is left."""
    tidy = plain(name)
    kept = F.array_join(F.filter(words(tidy), lambda w: ~w.isin(*LEGAL_FORMS)), " ")
    return F.when(kept == "", tidy).otherwise(kept)


def identifiers(text: Column) -> Column:
    """Map of registry label to code; codes hold a digit; the last one of a label wins."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(IDENTIFIER), 1).alias("label"), F.regexp_extract_all(text, F.lit(IDENTIFIER), 2).alias("code"))
    good = F.filter(F.coalesce(pairs, F.array().cast("array<struct<label:string,code:string>>")), lambda p: p["code"].rlike("[0-9]"))
    last = F.filter(good, lambda p, i: ~F.exists(F.slice(good, i + 2, F.greatest(F.size(good), F.lit(1))), lambda q: q["label"] == p["label"]))
    return F.map_from_entries(last)


def scope_tags(scope: Column) -> Column:
    """Sorted distinct words of more than two letters without stopwords."""
    return F.array_sort(F.array_distinct(F.filter(words(plain(scope)), lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS))))


def simple_attribute(attribute: Column) -> Column:
    return plain(attribute)


def signature(attribute: Column) -> Column:
    """Sorted distinct words that say what kind of measurement a phrase means."""
    return F.array_sort(F.array_distinct(F.filter(words(plain(attribute)), lambda w: w.isin(*MEASURES))))


def learn_year_end(facts: DataFrame) -> DataFrame:
    """One row (month, day): the commonest end of a financial year in period_raw, the first seen of equals, else 31 December."""
    named = facts.where(parsing.is_year_end_phrase(F.col("period_raw"))).select("fact_id", parsing.parse_date(F.col("period_raw")).alias("d")).where("d IS NOT NULL")
    best = named.groupBy(F.month("d").alias("month"), F.dayofmonth("d").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min("fact_id").alias("first"))
    top = best.agg(F.min(F.struct(-F.col("n"), "first", "month", "day")).alias("b"))
    return top.select(F.coalesce("b.month", F.lit(12)).alias("month"), F.coalesce("b.day", F.lit(31)).alias("day"))


def normalised(facts: DataFrame, year_end: DataFrame | None = None) -> DataFrame:
    """facts with value_num, multiplier, currency, period_start, period_end, as_of_date from their raw columns. year_end: month, day; learnt from the facts if not given."""
    end = (learn_year_end(facts) if year_end is None else year_end).select(F.struct("month", "day")).scalar()
    number = F.when(F.col("value_kind") == "number", parsing.parse_number(F.col("value_raw"), F.col("unit"), F.col("currency")))
    period = F.when(F.coalesce("period_raw", F.lit("")) != "", parsing.parse_period(F.col("period_raw"), F.col("_fy.month"), F.col("_fy.day")))
    stated = F.when(F.coalesce("as_of_raw", F.lit("")) != "", parsing.parse_date(F.col("as_of_raw")))
    as_of = F.when(F.col("value_kind") == "date", F.coalesce(stated, parsing.parse_date(F.col("value_raw")))).otherwise(stated)
    read = facts.withColumn("_fy", end).withColumns({"number": number, "period": period, "as_of_date": as_of})
    read = read.withColumns({"value_num": F.col("number.value"), "multiplier": F.col("number.multiplier"), "currency": F.coalesce("number.currency", "currency")})
    return read.withColumns({"period_start": F.col("period.start"), "period_end": F.col("period.end")}).drop("number", "period", "_fy")


def main_subjects(facts: DataFrame) -> DataFrame:
    """doc_id, main_subject: the commonest simplified subject of a document that isn't a self-reference; first seen of equals."""
    named = facts.where(F.coalesce(F.col("subject_raw"), F.lit("")) != "").where(~is_self_reference(F.col("subject_raw"))).select("doc_id", "fact_id", simple_name(F.col("subject_raw")).alias("name")).where("name <> ''")
    counted = named.groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min("fact_id").alias("first"))
    return counted.groupBy("doc_id").agg(F.min_by("name", F.struct(-F.col("n"), "first")).alias("main_subject"))


def resolved_subjects(facts: DataFrame) -> DataFrame:
    """facts with subject: the simplified one, or the document's main subject for none and self-references."""
    own = F.when((F.coalesce(F.col("subject_raw"), F.lit("")) == "") | is_self_reference(F.col("subject_raw")), F.lit(None)).otherwise(F.nullif(simple_name(F.col("subject_raw")), F.lit("")))
    return facts.join(main_subjects(facts), "doc_id", "left").withColumn("subject", F.coalesce(own, "main_subject", F.lit(UNNAMED))).drop("main_subject")


def similar_phrases(phrases: DataFrame, least: float, block: list[str]) -> DataFrame:
    """Edges (src, dst, score) from each phrase that may lead to those ranked after it that score at least `least` with it.

    phrases: phrase, tidy, place (sorts by rank), may_lead and the block columns. A pair that scores t has an indel distance of at
    most (1 - t)(a + b), each step of which spoils at most two bigrams. So two such phrases share one of
    their 4 (1 - t) length + 1 rarest bigrams (padded at the ends, repeats counted apart), and only those meet.
    """
    slack = 1 - least / 100
    padded = F.concat(F.lit("\x02"), "tidy", F.lit("\x03"))
    raw = F.transform(F.sequence(F.lit(1), F.length("tidy") + 1), lambda i: F.substring(padded, i, F.lit(2)))
    counted = phrases.withColumn("raw", raw).select("phrase", F.length("tidy").alias("size"), *block, F.posexplode("raw").alias("i", "gram"))
    occurrence = F.row_number().over(Window.partitionBy("phrase", "gram").orderBy("i"))
    counted = counted.select("phrase", "size", *block, F.concat("gram", F.lit("\x04"), occurrence.cast("string")).alias("gram"))
    rare = counted.groupBy(*block, "gram").agg(F.count(F.lit(1)).alias("n"))
    ranked = counted.join(rare, [*block, "gram"]).withColumn("r", F.row_number().over(Window.partitionBy("phrase").orderBy("n", "gram")))
    keys = ranked.where(F.col("r") <= F.floor(4 * slack * F.col("size")) + 1).select("phrase", *block, "gram")
    known = phrases.select("phrase", "tidy", "place", "may_lead")
    side = lambda x: keys.join(known, "phrase").select(*block, "gram", *(F.col(c).alias(f"{x}_{c}") for c in ("phrase", "tidy", "place", "may_lead")))
    a, b = side("a").where("a_may_lead"), side("b")
    total, apart = F.length("a_tidy") + F.length("b_tidy"), F.abs(F.length("a_tidy") - F.length("b_tidy"))
    met = a.join(b, [*block, "gram"]).where((F.col("a_place") < F.col("b_place")) & (apart <= slack * total + 1e-9)).select("a_phrase", "b_phrase", "a_tidy", "b_tidy", "a_place").distinct()
    scored = met.withColumn("score", token_sort_ratio_udf()("a_tidy", "b_tidy"))
    return scored.where(F.col("score") >= least).select(F.col("a_phrase").alias("src"), F.col("b_phrase").alias("dst"), "score", F.col("a_place").alias("place"))


def clusters(phrases: DataFrame, least: float, leader_count: int = 1, block: str | None = None) -> DataFrame:
    """phrases (phrase, n, first) with leader and leads, by the leader algorithm, commonest phrase first.

    A phrase joins the best-scoring leader before it (the earlier of equals) that reaches `least`, else it
    leads itself if it occurs at least leader_count times, else it stands alone. With a block
    column only phrases of one block meet. Leaders are the lexicographically first maximal independent set of the graph of similar phrases,
    found in rounds: who has no undecided or leading phrase before it leads, who has a leader before it doesn't.
    """
    keys = [block] if block else []
    place = F.struct((-F.col("n")).alias("n"), F.col("first").alias("first"))
    named = stored(phrases.withColumns({"tidy": sorted_tokens(F.col("phrase")), "place": place, "may_lead": F.col("n") >= leader_count}).select("phrase", "tidy", "place", "may_lead", *keys), "phrases")
    edges = stored(similar_phrases(named, least, keys), "phrase-edges")
    state = stored(named.select("phrase", F.when(F.col("may_lead"), "open").otherwise("never").alias("state")), "phrase-states")
    while not state.where("state = 'open'").isEmpty():
        before = edges.join(state.select(F.col("phrase").alias("src"), F.col("state").alias("src_state")), "src")
        seen = before.groupBy("dst").agg(F.max((F.col("src_state") == "leads").cast("int")).alias("led"), F.max((F.col("src_state") == "open").cast("int")).alias("waits"))
        joined = state.join(seen, state.phrase == seen.dst, "left")
        decided = F.when(F.col("state") != "open", F.col("state")).when(F.col("led") == 1, "follows").when(F.coalesce("waits", F.lit(0)) == 0, "leads").otherwise("open")
        state = stored(joined.select("phrase", decided.alias("state")), "phrase-states")
    leaders = state.where("state = 'leads'").select(F.col("phrase").alias("src"))
    best = edges.join(leaders, "src").groupBy("dst").agg(F.min_by("src", F.struct(-F.col("score"), F.col("place"))).alias("best"))
    joined = state.join(best, state.phrase == best.dst, "left")
    leads = F.col("state") == "leads"
    return joined.select("phrase", F.when(leads, F.col("phrase")).otherwise(F.coalesce("best", "phrase")).alias("leader"), leads.alias("leads"))


def entity_leaders(facts: DataFrame) -> DataFrame:
    """phrase, leader, leads over the simplified subjects of facts (with column subject)."""
    names = facts.groupBy(F.col("subject").alias("phrase")).agg(F.count(F.lit(1)).alias("n"), F.min("fact_id").alias("first"))
    return clusters(names, NAME_SCORE)


def family_leaders(facts: DataFrame) -> DataFrame:
    """phrase, leader, leads over attribute phrases: only phrases of one signature meet."""
    phrases = facts.select("fact_id", simple_attribute(F.col("attribute_raw")).alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("n"), F.min("fact_id").alias("first"))
    return clusters(phrases.withColumn("signature", F.array_join(signature(F.col("phrase")), " ")), ATTRIBUTE_SCORE, LEADER_COUNT, "signature")


def entities(facts: DataFrame) -> DataFrame:
    """entity_id, canonical_name, aliases, identifiers, n_facts per leader. facts: fact_id, subject_raw, leader.

    The canonical name is the commonest spelling, the first seen of equals; self-references and
    missing subjects spell nothing.
    """
    spelled = facts.withColumn("spelling", F.when((F.coalesce(F.col("subject_raw"), F.lit("")) != "") & ~is_self_reference(F.col("subject_raw")), F.col("subject_raw")))
    counted = spelled.groupBy("leader", "spelling").agg(F.count(F.lit(1)).alias("n"), F.min("fact_id").alias("first"))
    named = F.when(F.col("spelling").isNotNull(), F.struct(-F.col("n"), F.col("first"), F.col("spelling")))
    merged = counted.groupBy("leader").agg(F.min(named).alias("best"), F.array_sort(F.collect_set("spelling")).alias("aliases"), F.sum("n").alias("n_facts"))
    codes = identifiers(F.array_join("aliases", " ; "))
    return merged.select(readable_id("ent", F.col("leader")).alias("entity_id"), F.coalesce("best.spelling", "leader").alias("canonical_name"), "aliases", codes.alias("identifiers"), "n_facts")


def offered_labels(sizes: DataFrame) -> DataFrame:
    """label, n_facts of the families that a merge is asked about: at least three facts, the 260 largest."""
    return sizes.where(F.col("n_facts") >= MERGE_LEAST_FACTS).orderBy(F.desc("n_facts"), "label").limit(MERGE_MOST_LABELS).select("label", "n_facts")


def semantic_merge(sizes: DataFrame, groups: DataFrame | None) -> DataFrame:
    """label, final_label of families (label, n_facts), under groups (canonical, members) that a provider suggests.

    Offered are labels of at least three facts, the 260 largest. Unknown members are ignored; an unknown
    canonical label is replaced by the largest member. Without groups nothing changes.
    """
    if groups is None:
        return sizes.select("label", F.col("label").alias("final_label"))
    offered = offered_labels(sizes)
    members = groups.select("canonical", F.explode("members").alias("label")).join(offered, "label")
    largest = members.groupBy("canonical").agg(F.max_by("label", F.struct("n_facts", "label")).alias("largest"))
    known = offered.select(F.col("label").alias("canonical"), F.lit(True).alias("known"))
    named = members.join(largest, "canonical").join(known, "canonical", "left").select("label", F.when(F.col("known"), F.col("canonical")).otherwise(F.col("largest")).alias("final_label"))
    return sizes.join(named.groupBy("label").agg(F.min("final_label").alias("final_label")), "label", "left").select("label", F.coalesce("final_label", "label").alias("final_label"))


def family_rows(mapping: DataFrame) -> DataFrame:
    """family_id, label, member_phrases of a mapping (phrase, label)."""
    return mapping.groupBy("label").agg(F.array_sort(F.collect_set("phrase")).alias("member_phrases")).select(readable_id("fam", F.col("label")).alias("family_id"), "label", "member_phrases")


def coverage(facts: DataFrame) -> DataFrame:
    """One row: facts, parsed numbers, facts with a period, with an as-of date, with an entity, with scope tags."""
    some = lambda c: F.count_if(F.col(c).isNotNull())
    return facts.agg(
        F.count(F.lit(1)).alias("facts"), F.count_if(F.col("value_kind") == "number").alias("numeric"), some("value_num").alias("parsed"), some("period_start").alias("with_period"),
        some("as_of_date").alias("with_as_of"), some("entity_id").alias("with_entity"), F.count_if(F.size(scope_tags(F.col("scope_raw"))) > 0).alias("with_scope"),
    )


def top_entities(entity: DataFrame, facts: DataFrame, k: int = 10) -> DataFrame:
    """The k entities with most facts; entities without any count zero."""
    counted = facts.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    return entity.join(counted, "entity_id", "left").select("entity_id", "canonical_name", F.coalesce("n", F.lit(0)).alias("n_facts")).orderBy(F.desc("n_facts"), "entity_id").limit(k)
