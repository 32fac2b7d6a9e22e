"""Toxicity and tokens against brute force and the libraries."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attestor.llm import bpe, queries, token_counts, toxicity

DOCS = "doc_id long, text string"


def by_definition(s):
    """Maximal scoring segments: the best one, then those of what is left and right of it."""

    def split(lo, hi):
        best = None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += s[j]
                if total > 0 and (best is None or total > best[0] or (total == best[0] and j + 1 - i < best[2] - best[1])):
                    best = (total, i, j + 1)
        if best is None:
            return []
        return [*split(lo, best[1]), (best[1], best[2]), *split(best[2], hi)]

    return split(0, len(s))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([-3.1, -2.05, -1.01, 1.007, 2.03, 2.9]), max_size=14))
def test_segments(s):
    got = toxicity.segments_of(np.array(s, float))
    assert [(a, b) for a, b, _ in got] == by_definition(s)
    assert all(abs(sum(s[a:b]) - v) < 1e-9 for a, b, v in got)


TOXIC = ["vila", "vilb", "vilc", "vild", "vile", "vilf"]


def test_every_passage_scores_by_itself():
    scores = {"x": -0.75, **{w: 2.0 for w in TOXIC}}
    best = lambda words: sorted(v for _, _, v in toxicity.segments_of(toxicity.scored(words, scores)))[::-1]
    assert best([*TOXIC, *["x"] * 30, *TOXIC]) == pytest.approx([12.0, 12.0])
    assert best([*(y for w in TOXIC for y in [w, *["x"] * 10]), *TOXIC])[0] == pytest.approx(12.0)
    again = 6 * ((2 + toxicity.DRIFT) / 2 - toxicity.DRIFT)
    assert best([*TOXIC, *["x"] * 5, *TOXIC])[0] == pytest.approx(12 - 5 * 0.75 + again)
    assert best(["vila"] * 1000)[0] == pytest.approx(sum(max((2 + toxicity.DRIFT) / n - toxicity.DRIFT, 0) for n in range(1, 1001)))


def test_passages_after_mentions_and_twice(spark):
    docs, labels, _ = toy(spark)
    model = toxicity.fit(spark, docs, toxicity.learnable(labels))
    toxic = [w + c for w in ("vileness", "vilely", "vileling", "scumbag") for c in "abc"]
    plain = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    scattered = [y for w in toxic for y in [*plain, w]]
    texts = [[*plain, *toxic, *plain], [*plain, *toxic, *plain * 3, *toxic, *plain], [*scattered, *plain, *toxic, *plain], scattered]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], DOCS), model).collect()}
    assert len(got[0].passages) == 1 and len(got[1].passages) == 2 and len(got[2].passages) == len(got[3].passages) + 1
    last = max(got[2].passages, key=lambda p: p.start)
    assert " ".join(texts[2])[last.start : last.end] == " ".join(toxic)
    assert got[0].predicted == got[1].predicted == got[2].predicted == 1


def toy(spark, n=600, seed=1):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        y = int(i % 5 == 0)
        if y:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["vileness", "vilely", "vileling", "scumbag"]) + rng.choice("abc"))
        rows.append((i, " ".join(text)))
        labels.append((i, y))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_accuracy(spark):
    docs, labels, truth = toy(spark)
    model = toxicity.fit(spark, docs, toxicity.learnable(labels))
    got = toxicity.score(docs, model).collect()
    assert len(got) == 600 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in got) >= 585
    assert {r.doc_id for r in toxicity.filtered(docs, model).collect()} == {r.doc_id for r in got if not r.predicted}
    flagged = next(r for r in got if r.predicted)
    text = {r.doc_id: r.text for r in docs.collect()}[flagged.doc_id]
    assert any("vile" in text[p.start : p.end] or "scum" in text[p.start : p.end] for p in flagged.passages)


def test_toxicity_edges(spark):
    docs, labels, _ = toy(spark)
    model = toxicity.fit(spark, docs, labels)
    odd = spark.createDataFrame([(1, None, 5.0), (2, "", 1.0), (None, "vilenessa " * 3, 2.0), (4, "wa " * 30000, 0.0), (4, "wa " * 30000, 0.0)], "doc_id long, text string, score double")
    got = toxicity.score(odd, model).collect()
    assert [r.n_tokens for r in got] == [0, 0, 3, 30000, 30000] and got[0].score == got[1].score
    stay = toxicity.filtered(odd.drop("score"), model).collect()
    assert sorted(str(r.doc_id) for r in stay) == sorted(str(r.doc_id) for r in got if not r.predicted) and [r.predicted for r in got[:2]] == [0, 0]
    assert toxicity.filtered(odd, model).columns == odd.columns
    assert toxicity.score(odd.limit(0), model).count() == 0
    assert toxicity.fit(spark, docs, labels.where("toxic = 0")) is None and toxicity.fit(spark, docs.limit(0), labels) is None
    assert [r.predicted for r in toxicity.score(odd, None).collect()] == [0] * 5 and toxicity.filtered(odd, None).count() == 5


def test_offsets_where_lower_case_is_longer(spark):
    docs, labels, _ = toy(spark)
    text = "\u0130\u0130 \u0130stanbul " * 5 + "Vilenessa vilelyb vilelinga scumbagb vilenessc"
    row = toxicity.score(spark.createDataFrame([(1, text)], DOCS), toxicity.fit(spark, docs, labels)).first()
    assert text[row.passages[0].start : row.passages[0].end] == "Vilenessa vilelyb vilelinga scumbagb vilenessc"


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=10), st.tuples(st.integers(0, 40), st.integers(0, 40)).filter(any), min_size=1, max_size=30))
def test_entries_are_within_the_tolerance(counts):
    """Log-odds by a plain walk down all beginnings, without leaving any out."""
    base, held = 0.2, toxicity.entries(counts, 0.2)
    scores = toxicity.Scores(held)
    for token in counts:
        rate, last = base, None
        for key in toxicity.contexts(token):
            own = [sum(c[i] for w, c in counts.items() if key in toxicity.contexts(w)) for i in (0, 1)]
            if own != last:
                rate = toxicity.posterior(*own, rate)
            last = own
        want = np.log(rate / (1 - rate)) - np.log(base / (1 - base))
        assert abs(scores[token] + toxicity.DRIFT - want) <= toxicity.TOLERANCE + 1e-9


def test_held_out_labels(spark):
    """Labels that the model never sees: documents of the test tables whose label is held out."""
    tables = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{tables}/labels.parquet").where("toxic IN (0, 1)")
    rows = queries.op1_toxicity(spark, tables).join(labels, "doc_id").where("held_out").groupBy("toxic").avg("predicted").collect()
    rate = {r.toxic: r[1] for r in rows}
    assert rate[1] >= 0.9 and rate[0] <= 0.01


ALPHABET = list("  ▁\n\taéß<s>|endoft　字😀Σ'sİ\x1c\x85\xa0 ñ1²½Ⅷ́LL#@!\x00")
SPECIAL = ["", " ", "  a", "a ", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|>", "it's 123", "é’s", "x" * 3000, "▁", "▁▁ a"]


def randoms(n, seed):
    rng = random.Random(seed)
    return SPECIAL + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def sample(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]


def test_token_counts(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [None, *randoms(2000, 3), *sample(spark)]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], DOCS + ", n_tokens int")
    model = token_counts.load(path)
    for r in token_counts.token_counts(df, path).collect():
        t = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(model.encode(t)) if t else 0), repr(t)
        assert r.over_limit == (r.n_tokens > 4096)
    assert token_counts.token_counts(df.limit(0), path).count() == 0


def test_whole_tokens_are_proven():
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = token_counts.load(path)
    whole = token_counts.whole_tokens(path)
    assert len(whole) > 1000 and all(len(model.encode(w)) == 1 for w in whole)


def test_bpe(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = bpe.load(path).library
    texts = [None, *randoms(2000, 4), *sample(spark)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOCS + ", ids string")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in bpe.digests(df, path).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes())), repr(texts[r.doc_id])
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False).encode())
    one = bpe.encode(df.where("doc_id = 12"), path).first()
    assert one.ids == library.encode(texts[12], add_special_tokens=False).ids
    assert bpe.digests(df.limit(0), path).count() == 0


def test_generations_keep_results(monkeypatch):
    monkeypatch.setattr(bpe, "WORD_MEMO", 5)
    words = bpe.Words(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["alpha beta gamma delta epsilon zeta eta theta", "alpha iota kappa beta", "lambda mu alpha"] * 3
    for t in texts:
        ids, _ = words.encoded([t])[0]
        assert np.frombuffer(ids, "<u4").tolist() == words.library.encode(t, add_special_tokens=False).ids


def test_merging_many_at_once_is_merging_each():
    words = bpe.load(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(8)
    many = [words.symbols("".join(rng.choice("aeinorstaaa") for _ in range(rng.randint(1, 60))), True) for _ in range(800)]
    assert words.merged_all(many) == [words.merged(m) for m in many] and words.merged_all([]) == []


@pytest.mark.parametrize("seed", range(3))
def test_pairs_decide_whether_greedy_stands(seed):
    words = bpe.load(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(seed)
    for _ in range(300):
        w = "".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 14)))
        greedy = words.proposed(w)
        pairs = bool(words.pairs_stand(np.array([a * bpe.PAIR_BASE + b for a, b in zip(greedy, greedy[1:], strict=False)], np.int64)).all())
        assert pairs == (greedy == words.merged(words.symbols(w, True)))
