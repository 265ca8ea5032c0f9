import numpy as np
from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.operators import retrieve as R

ODD = [None, [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [0.0, 0.0], [1.0], [1.0, 2.0, 3.0], [], [1e-200, 1e-200], [1e200, 1e200], [-1.0, 0.5], [2.0, 1.0]]
SHAPES = "piece long, vector array<double>"


def by_pairs(queries, rows, k):
    return R.dense(queries, rows, k, score=lambda a, b: V.cosine(a, b))


def same(spark, vectors, asked, k):
    rows = spark.createDataFrame(vectors, SHAPES)
    queries = spark.createDataFrame(asked, "query long, qv array<double>")
    out = lambda d: sorted(map(repr, d.select("query", "piece", "score", "rank").collect()))
    got = out(R.dense(queries, rows, k))
    assert got == out(by_pairs(queries, rows, k))
    return got


def test_blocks_score_odd_vectors_as_pairs_do(spark):
    vectors = [(i, v) for i, v in enumerate(ODD * 3)] + [(None, [1.0, 1.0])]
    assert len(same(spark, vectors, list(enumerate(ODD)), 4)) == 4 * len(ODD)
    assert len(same(spark, vectors, [(None, [1.0, 0.0])], 100)) == len(vectors)
    assert same(spark, [], [(1, [1.0])], 3) == [] and same(spark, vectors, [], 3) == []


def test_ties_of_many_copies_go_by_id(spark):
    g = np.random.default_rng(5)
    base = g.normal(size=(30, 6)).tolist()
    vectors = [(5000 - i, base[i % 30]) for i in range(5000)]
    got = same(spark, vectors, [(i, base[i]) for i in range(10)], 20)
    assert len(got) == 200


def test_scores_are_rows_only_once_they_are_the_best(spark):
    g = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(g.normal(size=(3000, 8)).tolist())], SHAPES)
    found = R.dense(rows.where("piece % 50 = 0").select(F.col("piece").alias("query"), F.col("vector").alias("qv")), rows, 5)
    assert found.count() == 300
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan


def test_vector_scores_by_blocks(spark, tmp_path):
    from lodestone.plans.preparing import vector_scores

    rows = spark.createDataFrame([(i, v, 1) for i, v in enumerate(ODD * 5)], "vec_id long, embedding array<float>, label int")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    a, b = F.col("embedding"), F.col("qv")
    q = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), a.alias("qv"))
    want = rows.crossJoin(q).select("query", "vec_id", V.dot(a, b).alias("dot"), V.cosine(a, b).alias("cosine"), V.l2_score(a, b).alias("l2"))
    assert sorted(map(repr, vector_scores(spark, str(tmp_path)).collect())) == sorted(map(repr, want.collect()))


def test_memory_of_a_step_does_not_grow_with_the_queries():
    """Rows meet a tile of queries at a time: no matrix of a slice of rows by all queries."""
    import tracemalloc

    import pyarrow as pa

    from lodestone.operators import nearest as B

    g = np.random.default_rng(7)
    vectors = lambda n: pa.array(list(g.normal(size=(n, 8))), pa.list_(pa.float64()))
    best = B.Best(vectors(6000), 5, 9)
    tracemalloc.start()
    best.meet(pa.array(range(B.SLICE)), vectors(B.SLICE))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * B.SLICE * 6000 / 2
