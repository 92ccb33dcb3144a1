"""Hashed search: pairs of one bucket by naive comparison of the hashes, recall, and rows without a direction."""

import random

from pyspark.sql import functions as F

from spindrift.operators import retrieval as R


def test_ann_equals_pairs_that_share_a_bucket(spark, monkeypatch):
    import numpy as np
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.linalg import Vectors

    monkeypatch.setattr(R, "ANN_QUERIES", 7)  # several blocks of each bucket
    monkeypatch.setattr(R, "ANN_CORPUS", 50)
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(12)]) for i in range(300)]
    rows[7] = (7, rows[8][1])
    odd = [(300, [0.0] * 12), (301, None), (302, [float("nan")] * 12)]
    df = spark.createDataFrame(rows + odd, "doc_id long, vector array<double>")
    got = {}
    found = R.vector_topk_ann(df.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), df, width=0.3, tables=3)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.doc_id, r.score))
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, Vectors.dense(x)) for i, x in enumerate(unit.tolist())], ["id", "features"])
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=0.3, numHashTables=3, seed=7).fit(vectors)
    hashes = {r.id: [h[0] for h in r.hashes] for r in model.transform(vectors).collect()}
    score, less = np.round(unit @ unit.T, 6), 0
    for q in range(0, 300, 20):
        near = [i for i in range(300) if any(a == b for a, b in zip(hashes[q], hashes[i], strict=True))]
        less += 300 - len(near)
        want = sorted(near, key=lambda i: (-score[q, i], i))[:8]
        assert [x[:2] for x in sorted(got[q])] == [(n + 1, i) for n, i in enumerate(want)]
        assert all(abs(x[2] - score[q, x[1]]) < 2e-6 for x in got[q])
    assert less > 0 and set(got) == set(range(0, 300, 20))


def test_ann_recall_on_the_given_vectors(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    q = v.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    exact = {(r.query_id, r.doc_id) for r in R.vector_topk(q, v).collect()}
    assert len(exact & {(r.query_id, r.doc_id) for r in R.vector_topk_ann(q, v).collect()}) >= 0.9 * len(exact)
