"""Exact and near copies, lines, and components against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from attestor.llm import components, exact_index, line_templates, simhash

DOCS = "doc_id long, text string"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def roots(pairs):
    up: dict = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7), (3, 5), (5, 3), (None, 4)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components.components(df).collect()}
    want = roots([e for e in edges if None not in e and e[0] != e[1]])
    assert got == want
    assert components.components(df.limit(0)).count() == 0


def fingerprint(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < n else [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def corpus(seed=2, n=150):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    texts = [" ".join(word() for _ in range(rng.choice([0, 1, 2, 3, 40, 300]))) for _ in range(n)]
    for _ in range(n):
        t = rng.choice(texts).split(" ")
        if len(t) > 30 and rng.random() < 0.7:
            t[rng.randrange(len(t))] = word()
        texts.append(("  " if rng.random() < 0.5 else "\n").join(t))
    return [None, "", " \t", "ÀB Ab", *texts]


def check_near(spark, texts):
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], DOCS + ", fp string")
    fps = {i: fingerprint(t, 3) for i, t in rows}
    distinct = sorted(set(fps.values()))
    first = {f: min(i for i in fps if fps[i] == f) for f in distinct}
    pairs = [(first[a], first[b]) for k, a in enumerate(distinct) for b in distinct[k:] if (a ^ b).bit_count() <= 2]
    want = roots(pairs)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {r.doc_id: r.component_id for r in got} == {i: want[first[f]] for i, f in fps.items()}


def test_near_duplicates(spark):
    check_near(spark, corpus())


def test_near_duplicates_in_crowded_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 1)
    check_near(spark, corpus(3, 80))


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.kept_of_near_duplicates(empty).count() == 0
    assert exact_index.groups(empty).count() == 0 and exact_index.distinct_documents(empty).count() == 0
    assert line_templates.digest(empty).count() == 0


def planted(n=120):
    """Base texts, three near copies of each of the first 20, and unrelated texts."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows, group = [], {}
    for g in range(n):
        base = [word() for _ in range(rng.randint(60, 400))]
        for c in range(4 if g < 20 else 1):
            t = list(base)
            for _ in range(max(1, len(t) // 120) if c else 0):
                t[rng.randrange(len(t))] = word()
            group[len(rows)] = g
            rows.append((len(rows), " ".join(t), "src", float(c)))
    return rows, group


def test_one_of_each_near_group_stays(spark, monkeypatch):
    rows, group = planted()
    df = spark.createDataFrame([*rows, (500, None, "src", 0.0), (501, "", "s", 0.0)], DOCS + ", node string, `a.b` double")
    want = sorted([min(i for i in group if group[i] == g) for g in set(group.values())] + [500, 501])
    for radius in (simhash.STAGE_RADIUS, -1):  # also where no block links anything, so that the prefix filter finds all pairs
        monkeypatch.setattr(simhash, "STAGE_RADIUS", radius)
        kept = simhash.kept_of_near_duplicates(df)
        assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == want


def kept_by_hand(rows):
    grams = {i: set(simhash.hashes_of(t, 5).tolist()) for i, t in rows}
    pairs = [(a, b) for a in grams for b in grams if a <= b and grams[a] and 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b])]
    up = roots(pairs)
    return sorted(i for i, _ in rows if up.get(i, i) == i)


@pytest.mark.parametrize("radius", [simhash.STAGE_RADIUS, -1])  # also where blocks link nothing, so that the prefix filter finds all pairs
def test_similarity_is_exact_at_the_limit(spark, monkeypatch, radius):
    """Pairs a little over and a little under 0.8: an estimate takes some for the other kind."""
    monkeypatch.setattr(simhash, "STAGE_RADIUS", radius)
    rng, rows = random.Random(12), []
    for i in range(60):
        base = [f"w{rng.randrange(10**9)}" for _ in range(604)]
        copy = base[: 604 - (117 if i % 2 else 123)]  # of 600 shingles 483 or 477 are left: 0.805 and 0.795
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    want = kept_by_hand(rows)
    assert len(want) == 90
    assert sorted(r.doc_id for r in simhash.kept_of_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()) == want


@pytest.mark.parametrize("radius", [simhash.STAGE_RADIUS, -1])
def test_recall_of_pairs_from_the_limit_up(spark, monkeypatch, radius):
    """Similarities of 0.7 to 1 over texts of one base each, which share a passage with all others: every pair from 0.8 on is found."""
    monkeypatch.setattr(simhash, "STAGE_RADIUS", radius)
    rng, rows = random.Random(31), []
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(80)]
    for g in range(60):
        base = [*passage, *(word() for _ in range(rng.randint(20, 300)))]
        for c in range(rng.randint(1, 6)):
            t = list(base)
            for _ in range(round(len(t) * rng.choice([0, 0.01, 0.02, 0.025, 0.03, 0.04])) if c else 0):
                t[rng.randrange(len(t))] = word()
            rows.append((len(rows), " ".join(t)))
    assert sorted(r.doc_id for r in simhash.kept_of_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()) == kept_by_hand(rows)


def crowded(seed=21):
    """150 texts that share 85 % of their shingles (0.74 alike), and near copies of 40 of them."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**9)}"
    licence, texts = [word() for _ in range(344)], []
    for i in range(150):
        own = [word() for _ in range(60)]
        texts.append(licence + own)
        if i < 40:
            texts.append(licence + own[: 48 - i % 20] + [word() for _ in range(12 + i % 20)])
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_every_near_copy_is_found_where_blocks_are_crowded(spark, monkeypatch):
    rows = crowded()
    want = kept_by_hand(rows)
    assert 100 < len(want) < 190
    df = spark.createDataFrame(rows, DOCS)
    assert sorted(r.doc_id for r in simhash.kept_of_near_duplicates(df).collect()) == want
    monkeypatch.setattr(simhash, "keys_of", lambda shingles: [])  # without any block the prefixes find all
    assert sorted(r.doc_id for r in simhash.kept_of_near_duplicates(df).collect()) == want


def exact_by_hand(rows):
    """Rows of groups() in any order, and the normalised text, identifier and size of each that stays."""
    groups, out, stay = defaultdict(list), [], []
    for i, t in rows:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), i is None, i or 0, i))
    for normal, members in groups.items():
        members.sort()
        for place, (size, _, _, i) in enumerate(members):
            out.append((i, members[0][3], len(members), place == 0, hashlib.sha256(normal.encode()).hexdigest()))
            if not place:
                stay.append((normal, i, -size))
    return Counter(out), sorted(stay)


ROWS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, "a\tb "), (5, None), (6, ""), (7, " \n"), (8, "é\u00a0"), (9, "é"), (10, "ab"), (10, "ab"), (None, "a  b"), (11, "x" * 50000), (12, "x" * 50000), (3, "other"), (13, "oth er"), (13, "ot her"), (13, "oth er"), (20, "q r"), (20, "q\tr"), (21, "qr")]


def check_exact(spark, rows=ROWS):
    df = spark.createDataFrame([(*r, "z", True, 1) for r in rows], DOCS + ", digest string, row boolean, `a.b` int")
    want, stay = exact_by_hand(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_index.groups(df).collect()) == want
    kept = exact_index.distinct_documents(df)
    assert kept.columns == df.columns
    assert sorted((SPACE.sub("", r.text or ""), r.doc_id, len(r.text or "")) for r in kept.collect()) == stay


def test_exact(spark):
    check_exact(spark)


def test_exact_survives_collisions(spark, monkeypatch):
    """With a digest of one byte most texts collide; byte verification has to tell them apart."""
    rows = [(i, f"text {i % 12}" + " " * (i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(exact_index.F, "sha2", lambda c, n: F.hex(F.substring(F.sha1(c), 1, 1)))
    want = {(r[0], *r[1:4]) for r in exact_by_hand(rows)[0]}
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_index.groups(df).collect()} == want


def test_later_runs_meet_an_older_level(spark):
    rows = [(i, f"text {i % 70}" + " " * (i % 5)) for i in range(400)]
    parts = [spark.createDataFrame([r for r in rows if r[0] % 3 == k], DOCS) for k in range(3)]
    level = None
    for part in parts:
        level = exact_index.compacted(exact_index.flushed(part), level)
    whole = exact_index.compacted(exact_index.flushed(spark.createDataFrame(rows, DOCS)))
    plain = lambda df: sorted((bytes(r.digest), r.best.less, r.best.doc_id, r.group_size) for r in df.collect())
    assert plain(level) == plain(whole) and len(plain(level)) == 70


def lines_by_hand(rows):
    tokens = lambda line: ["<*>" if re.search("[0-9]", t) else t for t in SPACE.split(line) if t]

    def paths(t):
        half = 4 + (len(t) - 4) // 2
        return [("whole", *t)] + ([("first", len(t), *t[:half]), ("second", len(t), *t[:4], "..", *t[half:])] if len(t) >= 8 else [])

    texts = defaultdict(set)
    for _, text in rows:
        for line in (text.split("\n") if text is not None else []):
            for path in paths(tokens(line)) if tokens(line) else []:
                texts[path].add(text)
    gone = {p for p, d in texts.items() if len(d) >= (2 if p[0] == "whole" and len(p) > 51 else 10)}
    leaves = defaultdict(set)
    for _, text in rows:
        for line in (text.split("\n") if text is not None else []):
            if len(t := tokens(line)) >= 8:
                leaves[len(t), *t[:3]].add((text, tuple(t)))
    fields = set()
    for lines in leaves.values():
        n_texts = len({x for x, _ in lines})
        if n_texts < 10:
            continue
        seen = Counter((i, w) for _, t in lines for i, w in enumerate(t) if w != "<*>")
        named = defaultdict(list)
        for text, t in lines:
            x = tuple(w if seen[i, w] >= 10 and 16 * seen[i, w] >= len(lines) else "<*>" for i, w in enumerate(t))
            if 2 * sum(w != "<*>" for w in x[3:]) > len(t) - 3:
                named[x].append((text, t))
        for found in named.values():
            if len({x for x, _ in found}) >= 10 and 64 * len({x for x, _ in found}) >= n_texts:
                fields.update(found)
    out = []
    for i, text in rows:
        all_ = text.split("\n") if text is not None else []
        kept = [x for x in all_ if not (tokens(x) and (gone.intersection(paths(tokens(x))) or (text, tuple(tokens(x))) in fields))]
        out.append((i, len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest() if text is not None else None))
    return sorted(out, key=str)


def test_a_stray_line_shields_nothing(spark):
    """A licence line in 26 texts, a stray line of its length and first words, a notice whose end varies, a long passage in two texts and in copies of one."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    licence = " ".join(word() for _ in range(17))
    stray = " ".join(licence.split()[:4] + [word() for _ in range(13)])
    passage, alone = (" ".join(word() for _ in range(60)) for _ in range(2))
    rows = [(i, "\n".join([word(), licence, f"Sent from the office of {word()} {word()} by {word()}"])) for i in range(26)]
    rows += [(100, stray), (101, passage + "\nx"), (102, "y\n" + passage), (103, alone), (104, alone)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.n_dropped for r in line_templates.digest(df).collect()}
    assert [got[i] for i in range(26)] == [1] * 26 and [got[i] for i in range(100, 105)] == [0, 1, 1, 0, 0]
    notes = spark.createDataFrame([(i, f"Sent from the office of the mayor {word()} {word()} {word()} {i}") for i in range(12)], DOCS)
    assert [r.n_dropped for r in line_templates.digest(notes).collect()] == [1] * 12
    assert [(r.template, r.documents) for r in line_templates.templates(notes).collect()] == [("11 Sent from the office of the mayor ..", 12)]


def test_lines(spark):
    rng = random.Random(4)
    rows = []
    for i in range(40):
        lines = [" ".join(rng.choice(["the", "a", "of", "cat", "dog"]) for _ in range(rng.randint(1, 7))) for _ in range(5)]
        lines += [f"Copyright {2000 + i} by the  author number {i}", "", "\tLicensed under v2 ", f"Posted by user{i} on day {i} at home in {rng.choice('abc')}"]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(50, None), (51, ""), (52, "\n\n"), (53, "x " * 20000), (3, "Copyright 5 by the author number 9"), (None, "Licensed under v9"), (0, rows[0][1])]
    df = spark.createDataFrame([(*r, [1], 2) for r in rows], DOCS + ", lines array<int>, `a.b` int")
    assert sorted((tuple(r) for r in line_templates.digest(df).select("doc_id", "n_lines", "n_dropped", "text_sha256").collect()), key=str) == lines_by_hand(rows)
    assert line_templates.dropped(df).count() == len(rows)


def test_fields_at_any_place(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("bcdfgklm") for _ in range(7))
    rows = [(i, f"{word()} {word()}\nThis page of {word()} was last edited on behalf of the club by {word()} in our office\n{word()}") for i in range(500)]
    rows += [(1000 + i, " ".join(["This page of", *(word() for _ in range(13))])) for i in range(200)]
    rows += [(2000 + i, f"This page of {word()} was {word()} {word()} on {word()} of the {word()} by {word()} in {word()} {word()}") for i in range(40)]
    got = {r.doc_id: r.n_dropped for r in line_templates.digest(spark.createDataFrame(rows, DOCS)).collect()}
    assert [got[i] for i in range(500)] == [1] * 500 and not any(got[i] for i in got if i >= 1000)
    assert sorted((tuple(r) for r in line_templates.digest(spark.createDataFrame(rows, DOCS)).select("doc_id", "n_lines", "n_dropped", "text_sha256").collect()), key=str) == lines_by_hand(rows)


def test_common_words_of_a_large_leaf_are_no_template(spark):
    rng = random.Random(13)
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.45 else "".join(rng.choice("bcdfgklm") for _ in range(5))
    rows = [(i, "it is so " + " ".join(word() for _ in range(9))) for i in range(3000)]
    assert line_templates.digest(spark.createDataFrame(rows, DOCS)).where("n_dropped > 0").isEmpty()
