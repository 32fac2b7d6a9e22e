"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from attestor.plans import answers, documents  # noqa: F401
from attestor.plans import oracle as o
from attestor.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        files = glob.glob(f"{path}/*.parquet") if os.path.isdir(path) else [path]
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({files})")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def rows(names, data, order):
    at = [names.index(c) for c in order]
    return sorted((tuple(plain(r[i]) for i in at) for r in data), key=lambda r: [(v is not None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = df.collect()
    order = sorted(df.columns)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == order
    assert rows(df.columns, got, order) == rows(names, found.fetchall(), order)


@pytest.mark.parametrize("name", ["cache_misses", "chunk_stats", "failures_by_kind", "model_answers", "pack_requests", "prefilter", "request_prompts"])
def test_superscripts_and_marks_beside_names(spark, tmp_path, name):
    """Numbers of any kind go on with a word, combining marks and joiners end it."""
    said = ("Revenue² and Profit² fell", "Revenue½ and Profit½ fell", "①Revenue ①Profit fell", "Revenue\u0301 and Profit\u0301 fell", "Revenue\u200d and Profit\u200d fell", "Revenueé and Profité fell", "Revenue and Profit fell")
    table = [(i, f"{s} over it all", "en", "web", 9) for i, s in zip((1, 2, 3, 4, 6, 8, 9), said, strict=True)]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    df = QUERIES[name](spark, str(tmp_path))
    order = sorted(df.columns)
    found = con.execute(ORACLES[name])
    assert rows(df.columns, df.collect(), order) == rows([d[0] for d in found.description], found.fetchall(), order)


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """Lines of few parts: every bucket has more facts than the cap that other queries have."""
    at = tmp_path_factory.mktemp("crowded")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (l_partkey % 2 AS l_partkey) FROM '{DATA}/lineitem.parquet' ORDER BY l_orderkey, l_linenumber, l_extendedprice LIMIT 1800) TO '{at}/lineitem.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{at}/lineitem.parquet'")
    return con, str(at)


@pytest.mark.parametrize("name", ["case_1_corroborated", "case_2_contradicted", "case_3a_derived", "incremental_relations", "lost_facts", "settle_residual"])
def test_crowded_buckets_are_paired_whole(spark, crowded, name):
    con, at = crowded
    df = QUERIES[name](spark, at)
    got, order = df.collect(), sorted(df.columns)
    found = con.execute(ORACLES[name])
    assert rows(df.columns, got, order) == rows([d[0] for d in found.description], found.fetchall(), order) and got
    if "n" in order:
        pairs = f"WITH {o.NORMALISED}, cf AS (SELECT * FROM nf WHERE grounded AND (value_num IS NOT NULL OR value_text IS NOT NULL)) SELECT count(*), (SELECT min(n) FROM (SELECT count(*) AS n FROM cf GROUP BY entity_id, attribute_family)) FROM cf a JOIN cf b ON a.entity_id = b.entity_id AND a.attribute_family = b.attribute_family AND a.fact_id < b.fact_id WHERE a.doc_id <> b.doc_id OR a.page_no <> b.page_no OR a.value_num IS DISTINCT FROM b.value_num OR a.value_text IS DISTINCT FROM b.value_text OR a.period_start IS DISTINCT FROM b.period_start OR a.as_of_date IS DISTINCT FROM b.as_of_date OR a.scope_raw IS DISTINCT FROM b.scope_raw"
        every, least = con.execute(pairs).fetchone()
        assert least > 120 and sum(r.n for r in got) == every
    else:
        assert "place <= 120" not in ORACLES[name]


def test_entry_imports_without_the_operators_for_training_data():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
