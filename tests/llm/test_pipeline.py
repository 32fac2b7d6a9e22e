"""The pipeline's stages, each on its own input, and the queries against their SQL."""

import hashlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from attestor.llm import bpe, exact_index, mixing
from attestor.llm.oracles import ORACLES
from attestor.llm.queries import QUERIES
from tests.llm.test_copies import kept_by_hand
from tests.test_queries import DATA, duck, rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):  # noqa: F811
    df = QUERIES[name](spark, DATA)
    order = sorted(df.columns)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == order and rows(df.columns, df.collect(), order) == rows(names, found.fetchall(), order)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, held[-1], DATA).write.parquet(f"{tmp_path}/{name}")
        held.append(spark.read.parquet(f"{tmp_path}/{name}"))
    assert all(d.columns == docs.columns for d in held[:-1])
    before, clean, exact, near, mixed, encoded = ([tuple(r) for r in d.collect()] for d in held)
    assert set(clean) <= set(before) and len(clean) > 0.8 * len(before)
    groups = {r.doc_id: r for r in exact_index.groups(held[1]).collect()}
    assert {r[0] for r in exact} == {i for i, r in groups.items() if r.kept}
    assert set(near) <= set(exact)
    assert sorted(r[0] for r in near) == kept_by_hand([r[:2] for r in exact])
    copies = {r.row.doc_id: r.copies for r in mixing.planned(held[3]).collect()}
    assert sorted(r[0] for r in mixed) == sorted(i for i, n in copies.items() for _ in range(n))
    library = bpe.load(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json")).library
    texts = {r[0]: r[1] for r in mixed}
    assert len(encoded) == len(mixed)
    for doc_id, n, ids_sha, _ in encoded:
        ids = library.encode(texts[doc_id] or "", add_special_tokens=False).ids
        assert (n, ids_sha) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, DATA).collect()) == Counter(encoded)
