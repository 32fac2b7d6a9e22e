"""Toxic passages by maximum-scoring segment search.

1. Tokens get log-odds of toxic against clean documents under a mixture of Dirichlet priors (Brown et al.,
   1993) along the token's beginnings of LENGTHS letters: each beginning, and at last the token itself, either
   behaves as the shorter one does (a tight prior about its rate) or differs (a diffuse prior), and its
   log-odds are averaged over both. Noise of rare tokens so stays with their beginnings, and an inflection
   never seen in training gets the log-odds of the longest beginning that was.
2. A linear-time scan (Ruzzo and Tompa, 1999) over the scores of a text, log-odds less a drift,
   finds all maximal segments.
3. Segments are calibrated by the extreme-value law of Karlin and Altschul (1990): lambda solves
   E[exp(lambda s)] = 1 under the clean tokens, K is fitted to the best segments of clean
   documents, and a segment of raw score S among n distinct tokens has the score v = lambda S - ln(K n), where
   E = exp(-v) such segments are expected by chance.
4. Every segment adds the negative log of its p-value, 1 - exp(-E); a logistic curve over the sum gives
   the probability.

The model is fitted on at most TRAIN_POSITIVE + TRAIN_NEGATIVE labelled rows, chosen by the hash of
their identifier: two in three give the token counts for the calibration on the rest, then all give the
counts. Of the beginnings and tokens of that sample the model holds those whose log-odds differ by more
than TOLERANCE from what it holds for a shorter beginning, so no log-odds are off by more.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.work import pieces, small_batches, stored

TRAIN_POSITIVE = 12_000
TRAIN_NEGATIVE = 12_000
LENGTHS = (4, 5, 6, 7, 8)
BACKWARDS = LENGTHS[::-1]
#: Pseudo-counts of the tight and the diffuse prior, and the diffuse one's share.
TIGHT, DIFFUSE, DIFFERS = 500.0, 1.0, 1e-3
TOLERANCE = 0.02
DRIFT = 0.3
#: Evidence beyond this says no more: rows with wrong labels would bend the curve.
ENOUGH = 20.0
#: What near copies among the labelled rows are told by.
MINIMA, SHINGLE = 2, 5
#: Largest number of segments expected by chance of a passage that is reported.
SIGNIFICANT = 0.01
THRESHOLD = 0.7
#: Holds the curve's slope down where the classes are apart, so that its middle lies between them.
RIDGE = 5.0

WORDS = re.compile(r"[^\W\d_]+")
#: Ends the key of a whole token.
END = " "


def lowered(text: str) -> str:
    """Lower case with every character in its place: the one character whose lower case is longer is replaced first."""
    return text.replace("\u0130", "i").lower()


def tokens_of(text: str | None) -> list[str]:
    return WORDS.findall(lowered(text)) if text else []


def beta_binomial(a: float, b: float, x: float, y: float) -> float:
    """Log of the beta-binomial likelihood of counts a, b under pseudo-counts x, y, less the binomial coefficient."""
    return math.lgamma(a + x) + math.lgamma(b + y) - math.lgamma(a + b + x + y) - math.lgamma(x) - math.lgamma(y) + math.lgamma(x + y)


def posterior(toxic: int, clean: int, rate: float) -> float:
    """Toxic share of what has these counts, given that of its shorter beginning: log-odds averaged over both priors."""
    if toxic + clean == 0:
        return rate
    apart = math.log(DIFFERS / (1 - DIFFERS))
    if toxic + clean > 1:  # a single count is as likely under either prior, as both have the same mean
        apart += beta_binomial(toxic, clean, DIFFUSE * rate, DIFFUSE * (1 - rate)) - beta_binomial(toxic, clean, TIGHT * rate, TIGHT * (1 - rate))
    share = 1 / (1 + math.exp(-min(max(apart, -700), 700)))
    odds = [math.log((toxic + m * rate) / (clean + m * (1 - rate))) for m in (TIGHT, DIFFUSE)]
    return 1 / (1 + math.exp(-((1 - share) * odds[0] + share * odds[1])))


def contexts(token: str) -> list[str]:
    """Keys of a token's beginnings, short to long, and of the token itself."""
    return [token[:n] for n in LENGTHS if n <= len(token)] + [token + END]


def entries(counts: dict[str, tuple[int, int]], base: float) -> dict[str, float]:
    """Log-odds, less the base rate's, of the beginnings and tokens that differ from their shorter beginnings. counts: token to (toxic, clean)."""
    sums: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for token, (toxic, clean) in counts.items():
        for key in contexts(token):
            sums[key][0] += toxic
            sums[key][1] += clean
    shift = math.log(base / (1 - base))
    rates: dict[str, float] = {}
    held: dict[str, float] = {}
    for token in counts:
        rate, above, last = base, 0.0, None
        for key in contexts(token):
            if key not in rates:  # the same rows again are no further evidence
                rates[key] = rate if sums[key] == last else posterior(*sums[key], rate)
                odds = math.log(rates[key] / (1 - rates[key])) - shift
                if abs(odds - above) > TOLERANCE:
                    held[key] = odds
            rate, above, last = rates[key], held.get(key, above), sums[key]
    return held


class Scores(dict):
    """Token to score: the log-odds of the longest beginning that is held, less the drift."""

    def __init__(self, held: dict[str, float]):
        super().__init__()
        self.held = held

    def __missing__(self, token: str) -> float:
        held = self.held
        s = held.get(token + END)
        for n in BACKWARDS if s is None else ():
            if n <= len(token) and (s := held.get(token[:n])) is not None:
                break
        s = (s or 0.0) - DRIFT
        if len(self) > 150_000:
            self.clear()
        self[token] = s
        return s


def scored(words: list[str], scores: Scores) -> np.ndarray:
    """Score of each token. Repeats say ever less: the nth mention of a token in a segment has an nth of its log-odds.

    A segment ends where its running score has fallen to zero, so neither an earlier mention nor an earlier passage takes
    anything from a passage that stands by itself.
    """
    s = np.array([scores[w] for w in words], float)
    total = np.concatenate([[0.0], np.cumsum(np.minimum(s, 0))])
    seen: dict[str, int] = {}
    running, after = 0.0, 0
    for i in np.flatnonzero(s > 0).tolist():
        running += float(total[i] - total[after])
        if running <= 0:
            running = 0.0
            seen.clear()
        n = seen[words[i]] = seen.get(words[i], 0) + 1
        s[i] = (s[i] + DRIFT) / n - DRIFT
        running += float(s[i])
        after = i + 1
    return s


def segments_of(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), end exclusive, in linear time.

    Runs of scores that aren't positive are skipped by their cumulative sum, so the loop is over positive tokens only.
    """
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    total = np.cumsum(scores)
    found: list[list] = []  # start, end, sum before start, sum at end; each points to the last segment with a smaller sum before it
    back: list[int] = []
    for i in at.tolist():
        low, high, start, end = float(total[i] - scores[i]), float(total[i]), i, i + 1
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= low:
                j = back[j]
            if j < 0 or found[j][3] >= high:
                break
            start, low = found[j][0], found[j][2]
            del found[j:], back[j:]
            j -= 1
        found.append([start, end, low, high])
        back.append(j)
    return [(s, e, h - lo) for s, e, lo, h in found]


def counts(sample: DataFrame) -> DataFrame:
    """Documents of either class that hold a token, of those for the calibration's counts and of all: token, t, c, toxic, clean. sample: text, toxic, part."""

    def per_batch(batches):
        for batch in pieces(batches, 1024):
            by: dict[tuple[int, bool], Counter] = defaultdict(Counter)
            for text, y, part in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "part")), strict=True):
                by[y, part < 2].update(set(tokens_of(text)))
            keys = list(set().union(*by.values()))
            first = [[by[y, True][k] for k in keys] for y in (1, 0)]
            whole = [[by[y, True][k] + by[y, False][k] for k in keys] for y in (1, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array(x, pa.int64()) for x in (*first, *whole))], ["token", "t", "c", "toxic", "clean"])

    return sample.mapInArrow(per_batch, "token string, t long, c long, toxic long, clean long").groupBy("token").agg(*(F.sum(c).alias(c) for c in ("t", "c", "toxic", "clean")))


def lexicon(counted: DataFrame, toxic: str, clean: str) -> dict[str, float]:
    """Entries of all tokens of the counts in two columns; tokens of one beginning are worked on together."""
    sums = counted.agg(F.sum(toxic).alias("t"), F.sum(clean).alias("c")).first()
    if not sums.t or not sums.c:
        return {}
    base = sums.t / (sums.t + sums.c)

    def run(batches):
        held = entries({w: (t, c) for batch in batches for w, t, c in zip(*(x.to_pylist() for x in batch.columns), strict=True)}, base)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.float64())], ["key", "odds"])

    together = counted.where(F.col(toxic) + F.col(clean) > 0).select("token", toxic, clean).repartition(F.substring("token", 1, LENGTHS[0]))
    return {r.key: r.odds for r in together.mapInArrow(run, "key string, odds double").collect()}


def karlin_lambda(histogram: Counter) -> float:
    """The positive root of E[exp(lambda s)] = 1 over a histogram of clean token scores, within 0.05 to 16."""
    s, n = np.array(list(histogram), float), np.array(list(histogram.values()), float)
    lo, hi = 0.05, 16.0
    if not len(s) or s.max() <= 0:
        return 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if float((n / n.sum() * np.exp(np.minimum(mid * s, 700))).sum()) < 1 else (lo, mid)
    return (lo + hi) / 2


def total_of(values: list[float]) -> float:
    """Evidence of calibrated segment scores: the negative logs of their p-values added up, at most ENOUGH."""
    return min(sum(v if v > 30 else -math.log(-math.expm1(-math.exp(-v))) if v > -6 else 0.0 for v in values), ENOUGH)


def evidence(words: list[str], scores: Scores, lam: float, k: float) -> tuple[float, list[tuple[int, int, float]]]:
    """The evidence of a text, and its segments: start, end, calibrated score."""
    less = math.log(max(k * len(set(words)), 1e-9)) if words else 0.0
    found = [(start, end, lam * s - less) for start, end, s in segments_of(scored(words, scores))]
    return total_of([v for _, _, v in found]), found


def features(total: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), total], 1)


def probability(total, curve: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features(np.atleast_1d(np.asarray(total, float))) @ curve, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weighted logistic regression by Newton steps, with a ridge on all but the constant."""
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def sampled(spark: SparkSession, docs: DataFrame, known: DataFrame) -> DataFrame:
    """text, toxic, part (0 to 2) of the rows to learn from: each text once, toxic if any of its rows is, and one of each set of near copies.

    Near copies would count a rare token as often as they are copied. They are told by minima of hashed shingles: a text that
    shares one of MINIMA minima with another is learnt from only if it comes first, by hash, among those that share it.
    """
    chosen = [r for y, most in ((1, TRAIN_POSITIVE), (0, TRAIN_NEGATIVE)) for r in known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]
    picked = spark.createDataFrame([(r.doc_id, r.toxic) for r in chosen], "doc_id long, toxic int")
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where("text IS NOT NULL").groupBy("text").agg(F.max("toxic").alias("toxic"))
    multipliers = [np.uint64(xxhash.xxh64_intdigest(b"copy %d" % i) | 1) for i in range(MINIMA)]

    def run(batches):
        for batch in pieces(batches):
            keys = []
            for text in batch.column("text").to_pylist():
                words = text.lower().split()
                n = max(len(words) - SHINGLE, 0) + 1
                hashed = np.fromiter((xxhash.xxh64_intdigest(" ".join(words[i : i + SHINGLE]).encode("utf-8", "surrogatepass")) for i in range(n)), np.uint64, n)
                keys.append([int((x := hashed * m, x ^ x >> np.uint64(29))[1].min().view(np.int64)) for m in multipliers])
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("toxic"), pa.array(keys, pa.list_(pa.int64()))], ["text", "toxic", "keys"])

    keyed = stored(texts.mapInArrow(run, "text string, toxic int, keys array<long>").withColumn("at", F.xxhash64("text")), "toxicity-texts")
    copies = keyed.select("at", F.posexplode("keys")).groupBy("pos", "col").agg(F.min("at").alias("first"), F.collect_set("at").alias("of")).select("first", F.explode("of").alias("at")).where("at <> first").select("at").distinct()
    return keyed.join(copies, "at", "left_anti").select("text", "toxic", F.pmod(F.xxhash64("text", F.lit("part")), F.lit(3)).alias("part"))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> dict | None:
    """The model, or None where labels lack one of the classes. docs: doc_id, text; labels: doc_id, toxic (0 or 1).

    Labels with a null or another value are left out; repeated labels of a doc_id count as toxic if any is. Rows with equal
    texts are learnt from once, null texts not at all. Ties of the hash that chooses rows go to the smaller doc_id.
    """
    small_batches(spark)
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    rows = stored(sampled(spark, docs, known), "toxicity-sample")
    counted = stored(counts(rows), "toxicity-counts")
    held = lexicon(counted, "t", "c")

    def raw(batches):
        scores = Scores(held)
        for batch in pieces(batches):
            out = []
            for text in batch.column("text").to_pylist():
                words = tokens_of(text)
                s = scored(words, scores)
                bins = Counter(np.round(s * 20).astype(int).tolist())
                out.append((len(set(words)), [x[2] for x in segments_of(s)], list(bins), list(bins.values())))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()))))], ["toxic", "n", "segments", "bins", "sizes"])

    got = rows.where("part = 2").select("text", "toxic").mapInArrow(raw, "toxic int, n long, segments array<double>, bins array<long>, sizes array<long>").collect()
    if len({r.toxic for r in got}) < 2:
        return None
    histogram: Counter = Counter()
    for r in got:
        if not r.toxic:
            histogram.update({b / 20: n for b, n in zip(r.bins, r.sizes, strict=True)})
    lam = karlin_lambda(histogram)
    null = [(r.n, max(r.segments, default=0.0)) for r in got if not r.toxic and r.n]
    k = len(null) / max(sum(n * math.exp(-lam * s) for n, s in null), 1e-9) if null else 1.0
    k = min(max(k, 1e-6), 1e3)
    x = features(np.array([total_of([lam * s - math.log(max(k * r.n, 1e-9)) for s in r.segments]) for r in got]))
    y = np.array([r.toxic for r in got], float)
    share = sizes[1] / (sizes[0] + sizes[1])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return {"held": lexicon(counted, "toxic", "clean"), "lambda": lam, "k": k, "curve": fit_logistic(x, y, weight), "base": share}


def judged(batch: pa.RecordBatch, scores: Scores, model: dict) -> tuple[np.ndarray, list[int], list[list[tuple[int, int, float]]]]:
    """Probability, number of tokens and segments of each text of a batch: what both the query and the filter go by."""
    words = [tokens_of(text) for text in batch.column("text").to_pylist()]
    found = [evidence(w, scores, model["lambda"], model["k"]) for w in words]
    return probability([total for total, _ in found], model["curve"]), [len(w) for w in words], [segments for _, segments in found]


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs (doc_id, text) with score, predicted, n_tokens and passages: first and last character, calibrated score and E-value.

    Null and empty texts have no tokens and get the score of a text without segments. Repeated rows are
    scored alike. Without a model every row gets 0.5 and is not predicted. An empty table gives an empty result. Other columns are left out.
    """
    schema = "doc_id long, score double, predicted int, n_tokens long, passages array<struct<start:long,end:long,score:double,expected:double>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
    if model is None:
        return docs.selectExpr("doc_id", "0.5D AS score", "0 AS predicted", "CAST(NULL AS LONG) AS n_tokens", f"CAST(NULL AS {schema.split('passages ')[1]}) AS passages")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        scores = Scores(m["held"])
        least = -math.log(SIGNIFICANT)
        for batch in pieces(batches):
            p, lengths, found = judged(batch, scores, m)
            passages = []
            for i, segments in enumerate(found):
                sure = [x for x in segments if x[2] >= least]
                spans = [x.span() for x in WORDS.finditer(lowered(batch.column("text")[i].as_py()))] if sure else []
                passages.append([{"start": spans[s][0], "end": spans[e - 1][1], "score": v, "expected": math.exp(-v)} for s, e, v in sure])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype("int32")), pa.array(lengths, pa.int64()), pa.array(passages, kind)],
                ["doc_id", "score", "predicted", "n_tokens", "passages"],
            )

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def learnable(labels: DataFrame) -> DataFrame:
    """Label rows whose crc32 of the identifier's text leaves a remainder other than 1 by 3; the rest is held out."""
    return labels.select("doc_id", "toxic").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)


def filtered(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs without those predicted toxic: all columns, all other rows. Texts are scored where they lie, without a shuffle.

    Null and empty texts stay unless a text without segments is toxic by itself; repeated rows stay or go alike; without a
    model, as with labels of one class only, all rows stay. An empty table gives an empty result.
    """
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        scores = Scores(m["held"])
        for batch in pieces(batches):
            yield batch.filter(pa.array(judged(batch, scores, m)[0] < THRESHOLD, pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
