"""Texts that hold passages against plain containment, and vectors met in blocks."""

import random

import pytest

from sparkquill.operators import search
from sparkquill.operators.documents import holders

DIR = "/root/testdata/sf0.001"


def test_passages_of_any_length(spark):
    draw = random.Random(21)
    piece = lambda: draw.choice(["a", "ab", "abc", "ba", "é", " ", "  ", "\n", ".", "cab", "x"])
    docs = [(i, "".join(piece() for _ in range(draw.randint(0, 12)))) for i in range(60)] + [(100, None), (101, "")]
    items = [(i, "".join(piece() for _ in range(draw.randint(1, 6)))) for i in range(120)] + [(200, " "), (201, "\n"), (202, ""), (203, None), (204, "ab a"), (205, "c a b a")]
    got = {(r.item_id, r.doc_id) for r in holders(spark.createDataFrame(items, "item_id int, passage string"), spark.createDataFrame(docs, "doc_id int, text string").repartition(4)).collect()}
    assert got == {(i, d) for i, p in items for d, t in docs if p and t is not None and p in t}


def test_containment_has_no_nested_loop(spark):
    from sparkquill import catalogue

    for name in ("benchmark_containment", "quote_exact_verbatim"):
        plan = catalogue.QUERIES[name](spark, DIR)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("asked, held", [(2, 50), (1000, 7)])
def test_blocks_change_no_score(spark, monkeypatch, asked, held):
    rows = lambda: sorted(tuple(r) for r in search.semantic(spark, DIR).collect())
    want = rows()
    monkeypatch.setattr(search, "ASKED", asked)
    monkeypatch.setattr(search, "HELD", held)
    assert rows() == want and len(want) == 5 * 499


def test_no_task_has_the_table(spark, monkeypatch):
    """Without a broadcast, pairs are spread over many keys."""
    monkeypatch.setattr(search, "HELD", 50)
    set_ = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in set_}
    for k, v in set_.items():
        spark.conf.set(k, v)
    try:
        from pyspark.sql import functions as F

        n = [r[1] for r in search.semantic(spark, DIR).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(n) == 5 * 499 and max(n) < 0.7 * sum(n)


def vector_table(spark, tmp_path):
    """Vectors with copies, a null and near ones, and equal scores over several blocks; no zeros, which have the cosine 0 here and NaN in SQL."""
    draw = random.Random(4)
    some = [[round(draw.uniform(-1, 1), 2) for _ in range(3)] for _ in range(40)]
    rows = [(i, some[draw.randrange(40)] if i % 3 else [draw.uniform(-1, 1) for _ in range(3)], draw.choice([0, 1, None])) for i in range(700)]
    rows += [(701, None, 1), (702, [1e-7, 0.0, 0.0], 0), (None, some[0], 1), (800, some[0], 1), (801, some[0], 1)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_vector_queries_keep_ties_over_blocks(spark, monkeypatch, tmp_path):
    import duckdb

    from sparkquill import catalogue

    d = vector_table(spark, tmp_path)
    monkeypatch.setattr(search, "HELD", 60)
    monkeypatch.setattr(search, "AT_ONCE", 100)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet/*.parquet'")
    for name in ("knn_cosine", "hybrid_minmax", "ablation_modes", "retrieval_metrics"):
        df = catalogue.QUERIES[name](spark, d)
        want = con.sql(catalogue.SQL[name])
        got = sorted((tuple(r[c] for c in want.columns) for r in df.collect()), key=repr)
        assert got == sorted(want.fetchall(), key=repr), name


def test_no_pair_is_shuffled_that_no_list_keeps(spark, monkeypatch, tmp_path):
    """Of all pairs only the first of each block leave its task, so what is shuffled grows with the rows kept and not with the pairs."""
    d = vector_table(spark, tmp_path)
    monkeypatch.setattr(search, "HELD", 350)
    queries, blocks = 9, 4
    assert search.semantic(spark, d, 10).count() <= queries * blocks * 10
