"""Pruned top-k against all inner products, with clusters, ties, zeros and nulls."""

import numpy as np
import pytest

from spindrift.operators import pruned
from spindrift.operators.retrieval import vector_topk


def frame(spark, name, vectors, first=0):
    return spark.createDataFrame([(first + i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)], f"{name} long, vector array<double>")


def same(got, want):
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_clusters_are_passed_over(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    rows = np.concatenate([c + 0.02 * rng.normal(size=(60, 16)) for c in centres])
    rows = np.concatenate([rows, rows[:30]])  # ties
    q, c = frame(spark, "query_id", rows[::50]), frame(spark, "doc_id", rows)
    of = pruned.block_corpus(c, 24)
    top, told = pruned.query_corpus(q, of, 8)
    same(top, vector_topk(q, c, 8))
    share = [r.n_visited / r.n_blocks for r in told.collect()]
    assert len(share) == q.count() and np.mean(share) < 0.35
    same(pruned.query_corpus(q, of, 300)[0], vector_topk(q, c, 300))


def test_no_structure_zeros_nulls_and_few_rows(spark):
    rng = np.random.default_rng(2)
    rows = [*rng.normal(size=(300, 8)), *np.zeros((3, 8)), rng.normal(size=8)]
    q, c = frame(spark, "query_id", [*rows[:12], np.zeros(8), -rows[0]]), frame(spark, "doc_id", rows)
    for centroids in (1, 7, 256):
        same(pruned.query_corpus(q, pruned.block_corpus(c, centroids), 5)[0], vector_topk(q, c, 5))
    few = frame(spark, "doc_id", [rows[0], None, rows[1]])
    assert sorted((r.query_id, r.rank, r.doc_id) for r in pruned.query_corpus(frame(spark, "query_id", [rows[0], None]), few, 5)[0].collect()) == [(0, 1, 0), (0, 2, 2)]
    assert pruned.query_corpus(q, c.limit(0), 5)[0].count() == 0 and pruned.query_corpus(q.limit(0), c, 5)[0].count() == 0
    with pytest.raises(ValueError):
        pruned.query_corpus(q, c, 0)
