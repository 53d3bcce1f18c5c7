"""The pipeline's stages against brute force, and the registered queries."""

import random

import corpus_pipeline
import pytest
from papyrion.llm import decontaminate, mixing, quality, queries, sharding, sql
from papyrion.llm.common import table
from pyspark.sql import functions as F
from test_operators import awkward, slow_copies, slow_kept, slow_mix

import __spark_entry__


@pytest.fixture(scope="module")
def stages(spark, sf):
    """What every stage made of its predecessor's rows, as lists of rows."""
    docs, out = table(spark, sf, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf)
        out.append((docs.collect(), made.collect(), made.columns))
        docs = spark.createDataFrame(out[-1][1], made.schema)
    return out


def test_columns_stay(spark, sf, stages):
    want = table(spark, sf, "documents").columns
    assert [c for _, _, c in stages[:-1]] == [want] * 4 and stages[-1][2] == [*want, "shard"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "decontamination", "mixing", "sharding"]


def test_quality_stage(stages):
    before, after, _ = stages[0]
    want = slow_kept([(r.doc_id, r.text, r.lang, r.source) for r in before], quality.Params())
    assert {r.doc_id for r in after} == {i for i, (_, kept) in want.items() if kept}


def test_dedup_stage(stages):
    before, after, _ = stages[1]
    roots, least = slow_copies([r.text for r in before]), {}
    for r, g in zip(before, roots):
        least[g] = min(r.doc_id, least.get(g, r.doc_id))
    assert sorted(r.doc_id for r in after) == sorted(least.values()) and len(after) < len(before)


def test_decontamination_stage(spark, sf, stages):
    before, after, _ = stages[2]
    found = decontaminate.Matcher([(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()])
    items = [" ".join(decontaminate.tokens(r.text)) for r in table(spark, sf, "benchmark").collect()]
    kept = {r.doc_id for r in after}
    for r in before:
        whole = " ".join(decontaminate.tokens(r.text))
        if any(f" {i} " in f" {whole} " for i in items if len(i.split()) >= 8):
            assert r.doc_id not in kept
        assert (r.doc_id in kept) == (not found.find(r.text))


def test_mixing_stage(stages):
    before, after, _ = stages[3]
    want = slow_mix([(r.doc_id, r.text, r.lang, r.source) for r in before], corpus_pipeline.MIXTURE)
    assert sorted(r.doc_id for r in after) == sorted(k[0] for k, n in want.items() for _ in range(n * k[3]))
    assert 0.5 * len(before) < len(after) < len(before)


def test_sharding_stage(stages):
    before, after, _ = stages[4]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before) and all(0 <= r.shard < 64 for r in after)


def test_stages_take_awkward_rows(spark, sf):
    df = awkward(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, sf).count() >= 0
        assert stage(spark, df.limit(0), sf).count() == 0


def test_run(spark, sf, stages):
    got = sorted((r.doc_id, r.shard) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == sorted((r.doc_id, r.shard) for r in stages[-1][1])


def test_registration(spark):
    found = __spark_entry__.queries()
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)] and set(queries.QUERIES) | {"pipeline"} <= set(found)
    assert set(sql.ORACLE_SQL) <= set(queries.QUERIES)


def test_sql_agrees(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, text in sql.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, sf)
        made = con.execute(text)
        cols = [c[0] for c in made.description]
        assert sorted(cols) == sorted(df.columns), name
        assert sorted(map(repr, made.fetchall())) == sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()), name


def test_mixing_moves_shortages_to_siblings(spark):
    rows = [("d0", "en", "s0", 100), ("d0", "en", "s4", 1000), ("d0", "fr", "s0", 1000), ("d1", "en", "s1", 5000)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    p = mixing.Params(weights=({"d0": 1, "d1": 1}, {}, {}), share=300, max_epochs=1)
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(leaves, p).collect()}
    # 2130 tokens, 1065 a domain, 532 a language: s0 gives its 100, its sibling s4 takes over the rest
    assert got == {("d0", "en", "s0"): 100, ("d0", "en", "s4"): 432, ("d0", "fr", "s0"): 532, ("d1", "en", "s1"): 1065}


def test_decontamination_leaves_clean_documents(spark, sf):
    rng = random.Random(1)
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    m = decontaminate.Matcher(items)
    for _, t in items:
        w = decontaminate.tokens(t)
        rng.shuffle(w)
        assert len(w) < 8 or not m.find(" ".join(w)) or len(set(w)) < 5
    assert sharding.fill(["a"], 3) == [0, 0, 0] and F.lit(1) is not None
