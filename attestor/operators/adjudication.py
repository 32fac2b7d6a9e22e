"""Verdicts on pairs of facts: an ordered tree of rules as one CASE, and a proof by a third fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.text import fixed, shortened, tidy_number, trimmed
from attestor.operators.pairing import BUCKET_CAP, KEYS, pairs
from attestor.sources.scratch import released, stored

# Fixed values.
AGREEMENT = 0.005
BRIDGE = 0.002
LEAST_GAP = 50.0
COMPONENT_OF_ALL = 0.05
SAME_SCOPE = 0.5
POWER_SLACK = 0.01
LOW_CONFIDENCE = 0.6
PROPORTION_UNITS = ("%", "percent", "percentage", "pct", "bps", "basis points")
BOUNDS = (">", "<", "~", "≈", "+", "at least", "more than", "over")
MODEL_VERDICTS = ("corroborates", "contradicts", "reconciled", "superseded", "unrelated")
MODEL_PAIRS = 15
#: What the rules read of a fact.
JUDGED = ("fact_id", "doc_id", "page_no", *KEYS, "value_num", "value_text", "value_raw", "unit", "currency", "period_start", "period_end", "as_of_date", "scope_raw", "scope_tags", "confidence", "grounded")
#: Widths of the logarithmic bands that candidates for a gap are looked up by.
BAND = 0.0041


def relative_difference(x: Column, y: Column) -> Column:
    most = F.greatest(F.abs(x), F.abs(y))
    return F.when(most == 0, F.lit(0.0)).otherwise(F.abs(x - y) / most)


def is_proportion(side: str) -> Column:
    value, unit = F.coalesce(F.col(f"{side}.value_raw"), F.lit("")), F.lower(trimmed(F.coalesce(F.col(f"{side}.unit"), F.lit(""))))
    return value.contains("%") | unit.isin(*PROPORTION_UNITS)


def is_bound(side: str) -> Column:
    low, found = F.lower(F.coalesce(F.col(f"{side}.value_raw"), F.lit(""))), F.lit(False)
    for sign in BOUNDS:
        found = found | low.contains(sign)
    return found


def power_of_ten(x: Column, y: Column) -> Column:
    """The power that two numbers differ by, or null. Divided by ten step by step, as rounding must agree."""
    ratio = F.when((x != 0) & (y != 0), F.greatest(F.abs(x), F.abs(y)) / F.least(F.abs(x), F.abs(y)))
    start = F.struct(ratio.alias("r"), F.lit(0).alias("p"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, lambda s, _: F.when(s["r"] >= 9.9, F.struct((s["r"] / 10).alias("r"), (s["p"] + 1).alias("p"))).otherwise(s))
    good = F.filter(F.array(end), lambda s: (s["p"] > 0) & (F.abs(s["r"] - 1.0) <= POWER_SLACK))
    return F.get(F.transform(good, lambda s: s["p"]), F.lit(0))


def scope_overlap(x: Column, y: Column) -> Column:
    """Jaccard of two tag sets; 1 if both are empty, 0 if one is."""
    a, b = F.coalesce(x, F.array().cast("array<string>")), F.coalesce(y, F.array().cast("array<string>"))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def period_text(start: Column, end: Column, raw: Column) -> Column:
    span = F.when(start.isNotNull() & end.isNotNull(), F.concat(start.cast("string"), F.lit(" to "), end.cast("string")))
    return F.coalesce(F.nullif(raw, F.lit("")), span, end.cast("string"), F.lit("no period stated"))


def moment(side: str) -> Column:
    return F.coalesce(F.col(f"{side}.period_end"), F.col(f"{side}.as_of_date"))


def text_of(side: str) -> Column:
    return F.lower(trimmed(F.coalesce(F.col(f"{side}.value_text"), F.lit(""))))


def trust(side: str) -> Column:
    """Confidence, where none and zero both count as full."""
    c = F.col(f"{side}.confidence")
    return F.when(c.isNull() | (c == 0), 1.0).otherwise(c)


#: (leaf, verdict, method) in order of evaluation; the conditions stand in `conditions`.
LEAVES = (
    ("R1", "unrelated", "rule"), ("R2", "unrelated", "rule"), ("R3", "unrelated", "rule"), ("R4", "reconciled", "rule"), ("R5", "superseded", "rule"),
    ("R6", "reconciled", "rule"), ("R7", "reconciled", "rule"), ("R8", "corroborates", "rule"), ("R9", "needs_a_judgement", "rule"), ("R10", "corroborates", "rule"),
    ("R11", "reconciled", "rule"), ("R12", "reconciled", "rule"), ("R13", "reconciled", "derivation"), ("R14", "contradicts", "rule"), ("R15", "contradicts", "rule"),
)
#: A relation that lost a fact, or whose fact isn't grounded any more, is a candidate as before any verdict.
LOST = ("R19", "candidate", "blocking")


def conditions() -> dict[str, Column]:
    """What each leaf but the bridge asks of a pair (a, b), given that no leaf before it held."""
    c = F.col
    number_a, number_b = c("a.value_num").isNotNull(), c("b.value_num").isNotNull()
    tags = lambda s: F.size(F.coalesce(c(f"{s}.scope_tags"), F.array().cast("array<string>"))) > 0
    period = c("a.period_start").isNotNull() & c("b.period_start").isNotNull()
    apart = moment("a").isNotNull() & moment("b").isNotNull() & (moment("a") != moment("b"))
    return {
        "R1": (F.coalesce(c("a.currency"), F.lit("")) != "") & (F.coalesce(c("b.currency"), F.lit("")) != "") & (c("a.currency") != c("b.currency")),
        "R2": number_a != number_b,
        "R3": is_proportion("a") != is_proportion("b"),
        "R4": period & ((c("a.period_start") != c("b.period_start")) | ~c("a.period_end").eqNullSafe(c("b.period_end"))),
        "R5": apart & ~number_a & (text_of("a") != text_of("b")),
        "R6": apart & number_a,
        "R7": tags("a") & tags("b") & (scope_overlap(c("a.scope_tags"), c("b.scope_tags")) < SAME_SCOPE),
        "R8": ~number_a & (text_of("a") == text_of("b")),
        "R9": ~number_a,
        "R10": relative_difference(c("a.value_num"), c("b.value_num")) <= AGREEMENT,
        "R11": power_of_ten(c("a.value_num"), c("b.value_num")).isNotNull(),
        "R12": is_bound("a") | is_bound("b"),
        "R14": (trust("a") < LOW_CONFIDENCE) & (trust("b") < LOW_CONFIDENCE),
        "R15": F.lit(True),
    }


def first_leaf() -> Column:
    """The leaf of a pair, R14 and R15 still open to a bridge."""
    out = None
    for leaf, condition in conditions().items():
        out = F.when(condition, leaf) if out is None else out.when(condition, leaf)
    return out


def thin(found: DataFrame, more: dict[str, Column] | None = None, named: tuple[str, ...] | None = None) -> DataFrame:
    """relation_id, fact_a, fact_b, leaf of pairs, and of pairs that a third fact may explain what the search for it needs (`open`, else null).

    more: further columns, made of the pair and its leaf. named: leaves whose pairs keep their names, as open ones do; the names of all others
    are null, which take no room where pairs are only counted. None: all keep them.
    """
    c, gap = F.col, F.abs(F.col("a.value_num") - F.col("b.value_num"))
    needs = F.struct(
        "entity_id", gap.alias("gap"), is_proportion("a").alias("share"), F.array_compact(F.array("a.as_of_date", "b.as_of_date")).alias("days"), F.array_compact(F.array("a.period_end", "b.period_end")).alias("ends")
    )
    worth = (gap >= LEAST_GAP) & (relative_difference(gap, F.abs(c("a.value_num"))) > COMPONENT_OF_ALL) & (relative_difference(gap, F.abs(c("b.value_num"))) > COMPONENT_OF_ALL)
    leafed = found.withColumn("leaf", F.when(c("a.fact_id").isNull() | c("b.fact_id").isNull(), LOST[0]).otherwise(first_leaf()))
    open_ = c("leaf").isin("R14", "R15") & worth
    names = [c(x) if named is None else F.when(c("leaf").isin(*named) | open_, c(x)).alias(x) for x in ("relation_id", "fact_a", "fact_b")]
    return leafed.select(*names, "leaf", F.when(open_, needs).alias("open"), *(v.alias(k) for k, v in (more or {}).items()))


def bridges(open_pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """relation_id, bridging_fact_id of pairs (thin(), `open` set) whose gap exactly one other fact of the entity explains.

    A candidate is worth the gap to within BRIDGE, of the pair's kind, and shares a date with a side unless
    neither has one. Gaps and candidates meet by entity and logarithmic band, not entity alone: an
    entity with very many facts makes no more rows than there are values near a gap.
    """
    c = F.col
    band = lambda x: F.floor(F.log(x) / BAND)
    gaps = open_pairs.select("relation_id", "fact_a", "fact_b", "open.*")
    gaps = gaps.withColumn("band", F.explode(F.array_distinct(F.array(band(c("gap") * (1 - 2 * BRIDGE)), band(c("gap")), band(c("gap") * (1 + 2 * BRIDGE))))))
    values = facts.where("value_num >= 1").select("entity_id", F.struct("fact_id", "value_num", "value_raw", "unit", "as_of_date", "period_end").alias("c"))
    values = values.withColumn("band", band(c("c.value_num"))).withColumn("c_share", is_proportion("c"))
    dated = F.array_contains("days", c("c.as_of_date")) | F.array_contains("ends", c("c.period_end"))
    undated = (F.size("days") == 0) & (F.size("ends") == 0)
    near = relative_difference(c("c.value_num"), c("gap")) <= BRIDGE
    met = gaps.join(values, ["entity_id", "band"]).where(near & (c("c_share") == c("share")) & (F.coalesce(dated, F.lit(False)) | undated) & (c("c.fact_id") != c("fact_a")) & (c("c.fact_id") != c("fact_b")))
    return met.groupBy("relation_id").agg(F.count(F.lit(1)).alias("n"), F.first("c.fact_id").alias("bridging_fact_id")).where("n = 1").select("relation_id", "bridging_fact_id")


def explanations() -> dict[str, Column]:
    """The written reason of each leaf."""
    c = F.col
    a, b = (lambda x: c(f"a.{x}")), (lambda x: c(f"b.{x}"))
    gap, off = F.abs(a("value_num") - b("value_num")), relative_difference(a("value_num"), b("value_num"))
    percent = lambda x, n: F.concat(fixed(x * 100, n), F.lit("%"))
    later = moment("a") > moment("b")
    old = lambda f: F.when(later, f("b")).otherwise(f("a"))
    new = lambda f: F.when(later, f("a")).otherwise(f("b"))
    day = lambda s: moment(s).cast("string")
    quoted = lambda n: lambda s: shortened(c(f"{s}.value_text"), n)
    when = lambda s: F.coalesce(F.nullif(c(f"{s}.period_raw"), F.lit("")), F.nullif(c(f"{s}.as_of_raw"), F.lit("")), day(s))
    has = lambda s: F.size(F.coalesce(c(f"{s}.scope_tags"), F.array().cast("array<string>"))) > 0
    one_scope = F.when(has("a") != has("b"), F.concat(F.lit("; only one side is qualified: "), shortened(F.when(has("a"), a("scope_raw")).otherwise(b("scope_raw")), 60))).otherwise("")
    where = F.when(a("doc_id") == b("doc_id"), "one document").otherwise("two documents")
    small, large = F.least(a("value_num"), b("value_num")), F.greatest(a("value_num"), b("value_num"))
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts))
    return {
        "R1": say("currencies differ: ", a("currency"), " and ", b("currency")),
        "R2": say("a number and a text are not comparable"),
        "R3": say("a proportion (", F.when(is_proportion("a"), a("value_raw")).otherwise(b("value_raw")), ") and an amount are not comparable"),
        "R4": say("periods differ: ", period_text(a("period_start"), a("period_end"), a("period_raw")), " and ", period_text(b("period_start"), b("period_end"), b("period_raw"))),
        "R5": say("the state changed: at ", old(day), " \"", old(quoted(60)), "\", at ", new(day), " \"", new(quoted(60)), "\""),
        "R6": say("moments differ: ", when("a"), " and ", when("b")),
        "R7": say("scopes differ: \"", shortened(a("scope_raw"), 70), "\" and \"", shortened(b("scope_raw"), 70), "\""),
        "R8": say("both state \"", shortened(a("value_text"), 70), "\""),
        "R9": say("two statements without an order: \"", shortened(a("value_text"), 50), "\" and \"", shortened(b("value_text"), 50), "\""),
        "R10": say("both give ", a("value_raw"), ", in ", where, ", to within ", percent(off, 2)),
        "R11": say("a factor of 10^", power_of_ten(a("value_num"), b("value_num")).cast("string"), " apart: a matter of units"),
        "R12": say("a bound, not a measurement: ", a("value_raw"), " against ", b("value_raw")),
        "R13": say(tidy_number(small), " + ", tidy_number(c("bridge.value_num")), " = ", tidy_number(large), ": the gap of ", tidy_number(gap), " is \"", shortened(c("bridge.attribute_raw"), 60), "\" (", c("bridge.value_raw"), ", page ", c("bridge.page_no").cast("string"), ")"),
        "R14": say("they disagree: ", a("value_raw"), " against ", b("value_raw"), ", by ", percent(off, 1), ", but neither source is trusted much", one_scope),
        "R15": say("they disagree in ", where, ": ", a("value_raw"), " (page ", a("page_no").cast("string"), ") against ", b("value_raw"), " (page ", b("page_no").cast("string"), "), by ", percent(off, 1), one_scope),
    }


def by_leaf(values: dict[str, Column | str]) -> Column:
    out = None
    for leaf, value in values.items():
        out = F.when(F.col("leaf") == leaf, value) if out is None else out.when(F.col("leaf") == leaf, value)
    return out


def reason() -> Column:
    """The written reason of a pair with both facts, null for a proof by a third fact (explained() has that one's) and for a pair that lost a fact."""
    return by_leaf({leaf: text for leaf, text in explanations().items() if leaf != "R13"})


def verdicts(
    facts: DataFrame, cap: int | None = BUCKET_CAP, candidates: DataFrame | None = None, among: DataFrame | None = None, more: dict[str, Column] | None = None, named: tuple[str, ...] | None = None
) -> DataFrame:
    """relation_id, fact_a, fact_b, leaf, verdict, method, bridging_fact_id and `more` (`named`: thin()) of every candidate pair. What explains a gap is looked for `among` other facts if given.

    Pairs are made from the facts, or taken from candidates (relation_id, fact_a, fact_b), of which those without both facts
    among the grounded ones stay candidates. The rules are evaluated once: what later steps need of a pair, without its facts, is stored.
    Only pairs that a third fact may explain are joined to the proofs; the others stay where they lie.
    """
    if candidates is None:
        found = pairs(facts, cap)
    else:
        found = with_facts(candidates.select("relation_id", "fact_a", "fact_b"), facts.where("grounded")).withColumns({k: F.coalesce(f"a.{k}", f"b.{k}") for k in KEYS})
    judged = released(thin(found, more, named), "pairs")
    proofs = stored(bridges(judged.where("open IS NOT NULL"), (facts if among is None else among).where("grounded AND value_num IS NOT NULL")), "proofs")
    settled_ = judged.where("open IS NULL").drop("open").withColumn("bridging_fact_id", F.lit(None).cast("string"))
    searched = judged.where("open IS NOT NULL").drop("open").join(proofs, "relation_id", "left").withColumn("leaf", F.when(F.col("bridging_fact_id").isNotNull(), "R13").otherwise(F.col("leaf")))
    verdict, method = by_leaf({leaf: F.lit(v) for leaf, v, _ in (*LEAVES, LOST)}), by_leaf({leaf: F.lit(m) for leaf, _, m in (*LEAVES, LOST)})
    return settled_.unionByName(searched).select("relation_id", "fact_a", "fact_b", "leaf", verdict.alias("verdict"), method.alias("method"), "bridging_fact_id", *(more or {}))


def with_facts(relations: DataFrame, facts: DataFrame) -> DataFrame:
    """relations with both facts as structs a and b, null for a fact that isn't there."""
    side = lambda x: facts.select(F.col("fact_id").alias(f"fact_{x}"), F.struct(*facts.columns).alias(x))
    return relations.join(side("a"), "fact_a", "left").join(side("b"), "fact_b", "left")


def explained(relations: DataFrame, facts: DataFrame) -> DataFrame:
    """relations (verdicts(), all or some of them) with both facts and the written reason, of which a lost fact leaves none."""
    facts = facts.where("grounded")
    bridge = facts.select(F.col("fact_id").alias("bridging_fact_id"), F.struct("value_num", "attribute_raw", "value_raw", "page_no").alias("bridge"))
    full = with_facts(relations, facts).join(bridge, "bridging_fact_id", "left")
    return full.select("relation_id", "fact_a", "fact_b", "leaf", "verdict", "method", by_leaf(explanations()).alias("explanation"), "bridging_fact_id", "a", "b")


def adjudicated(facts: DataFrame, cap: int | None = BUCKET_CAP, candidates: DataFrame | None = None, among: DataFrame | None = None, named: tuple[str, ...] | None = None) -> DataFrame:
    """verdicts() of every candidate pair with both facts and the written reason, which pairs without names (`named`: thin()) don't have."""
    return explained(verdicts(facts, cap, candidates, among, named=named), facts if among is None else among)


def asked_first(relations: DataFrame, k: int = MODEL_PAIRS) -> DataFrame:
    """The k unsettled relations that a model is asked about: across documents first, then by relation_id."""
    same = F.col("a.doc_id") == F.col("b.doc_id")
    return relations.where("verdict = 'needs_a_judgement'").select("relation_id", same.alias("same_document")).orderBy("same_document", "relation_id").limit(k)


def settled(relations: DataFrame, answers: DataFrame | None = None, k: int = MODEL_PAIRS) -> DataFrame:
    """relations with the residue settled: the model's verdict, unrelated where it gave no valid one, undecided where it wasn't asked.

    answers: relation_id, verdict, explanation of a provider; None stands for a model that can't be reached.
    """
    asked = asked_first(relations, k).select("relation_id", F.lit(True).alias("asked"))
    null = F.lit(None).cast("string")
    given = answers.where(F.col("verdict").isin(*MODEL_VERDICTS)).select("relation_id", F.col("verdict").alias("said"), F.col("explanation").alias("why")) if answers is not None else None
    out = relations.join(F.broadcast(asked), "relation_id", "left")
    out = out.join(given, "relation_id", "left") if given is not None else out.withColumns({"said": null, "why": null})
    open_, answered = F.col("verdict") == "needs_a_judgement", F.col("asked") & F.col("said").isNotNull()
    verdict = F.when(~open_, F.col("verdict")).when(answered, F.col("said")).when(F.col("asked"), "unrelated").otherwise("undecided")
    reason = F.when(~open_, F.col("explanation")).when(answered, F.col("why")).when(F.col("asked"), F.concat(F.lit("no valid answer: "), "explanation")).otherwise(F.concat(F.lit("not asked: "), "explanation"))
    method = F.when(open_ & answered, "llm").otherwise(F.col("method"))
    return out.withColumns({"explanation": reason, "method": method, "verdict": verdict}).drop("asked", "said", "why")


def verdict_counts(relations: DataFrame) -> DataFrame:
    return relations.groupBy("verdict", "method").agg(F.count(F.lit(1)).alias("n"))


def verdict_share(relations: DataFrame) -> DataFrame:
    """verdict, n, percent of all; the total is a window over the few verdicts."""
    counted = relations.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 4))


def proofs(relations: DataFrame) -> DataFrame:
    return relations.where("bridging_fact_id IS NOT NULL").select("relation_id", "fact_a", "fact_b", "bridging_fact_id")

