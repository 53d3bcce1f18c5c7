"""Every registered query of the library runs; those with SQL agree with DuckDB row by row."""

import math

import pytest

from papyrion.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Whole extraction runs, which test_extraction covers.
SLOW = {"extraction_results", "insight_severities", "text_reports", "html_reports"}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = pytest.importorskip("duckdb").connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in SLOW])
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    got = rows(df.columns, df.collect())
    if name in catalog.ORACLE_SQL:
        made = duck.execute(catalog.ORACLE_SQL[name])
        names = [c[0] for c in made.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows(names, made.fetchall())


def test_flagship(spark, sf):
    found = catalog.flagship(spark, sf).collect()
    assert sum(r.n_docs for r in found) == 200


def test_small_tables_are_spread_and_large_ones_are_not(spark, sf):
    pages, n = catalog.table(spark, sf, "pages"), spark.sparkContext.defaultParallelism
    assert catalog.spread(pages).rdd.getNumPartitions() == n
    assert catalog.spread(pages, small=1).rdd.getNumPartitions() == pages.rdd.getNumPartitions()
    assert catalog.spread(pages).count() == pages.count()


@pytest.mark.parametrize("name", ["financial_statements", "resumes"])
def test_typed_documents_of_high_customer_numbers(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    path = str(tmp_path / "customer.parquet")
    con = duckdb.connect()
    con.execute(f"copy (select unnest([0, 1, 270242, 270243, 899999, 5000003, 99999990])::bigint as c_custkey) to '{path}' (format parquet)")
    con.execute(f"create view customer as select * from '{path}'")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism  # one row group, yet all cores
    made = con.execute(catalog.ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in made.description], made.fetchall())
