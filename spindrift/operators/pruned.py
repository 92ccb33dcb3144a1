"""Exact top-k by cosine over a corpus in blocks around centroids, with blocks passed over by a bound.

``block_corpus`` deals unit vectors to their nearest centroid, and a block in parts of ``PART`` rows; it is one written table, made once for a corpus.
On unit vectors a cosine c is a distance of sqrt(2 - 2 c), so no row of a block lies nearer to a query than its distance to the
centroid less the block's radius. A query first visits its nearest blocks that hold k rows together; its k-th score
there is a limit that the final k-th score can only better, and then it visits those blocks alone whose bound
is within that limit. Only pairs of a query and a block that it visits are made: nothing is copied for blocks that no query of a group visits.

The result is that of ``vector_topk``: scores of 6 decimals, ties by id. Centroids are rows of a sample of ``SAMPLE``; they set how much is
spared and never what is found. Rows of zero length have no direction: their score is 0 with all, so they lie in a block of their own that every query visits,
and a query of zero length visits all blocks. Null vectors take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators.novelty import _kept

CENTROIDS = 256
SAMPLE = 16_384
PART = 4_096
#: Queries that meet a part together.
GROUP = 2_048
#: Scores are rounded to 6 decimals, so what may tie with the k-th lies this much below it.
SLACK = 2e-6


@dataclass(frozen=True)
class Blocked:
    """``rows`` (block, part, doc_id, unit); and of each block its number, rows and radius. Block i is around ``centroids[i]``, -1 is of rows of zero length."""

    rows: DataFrame
    centroids: list[list[float]]
    blocks: list[tuple[int, int, float]]


def _unit(column):
    import numpy as np

    x = np.array(column.to_pylist(), np.float64)
    if not len(x):
        return x.reshape(0, 1), np.zeros(0, bool)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.maximum(norm, 1e-300), norm[:, 0] > 0


def block_corpus(corpus: DataFrame, centroids: int = CENTROIDS) -> Blocked:
    """``corpus``: doc_id, vector."""
    import numpy as np

    read = corpus.where("vector is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("vector").cast("array<double>").alias("vector"))
    sample = read.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).toArrow()  # bounded
    x, sound = _unit(sample["vector"])
    x = x[sound]
    chosen = [0] if len(x) else []
    near = np.full(len(x), -np.inf)
    while len(chosen) < min(centroids, len(x)):  # each next one is the row farthest from those before it
        near = np.maximum(near, x @ x[chosen[-1]])
        if near.min() > 1 - 1e-12:
            break
        chosen.append(int(near.argmin()))
    c = x[chosen]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u, has = _unit(b.column(1))
                score = u @ c.T if len(c) else np.zeros((len(u), 1))
                block = np.where(has, score.argmax(axis=1), -1)
                apart = np.where(has, np.sqrt(np.maximum(2 - 2 * score.max(axis=1), 0)), 0.0)
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), b.column(0), pa.array(list(u), pa.list_(pa.float64())), pa.array(apart)], ["block", "doc_id", "unit", "apart"])

    dealt = _kept(read.mapInArrow(deal, "block int, doc_id long, unit array<double>, apart double"), "blocks")
    sizes = [(r["block"], r["n"], r["radius"]) for r in dealt.groupBy("block").agg(F.count("*").alias("n"), F.max("apart").alias("radius")).collect()]  # a row for each centroid at most
    parts = F.create_map(*[F.lit(v) for b, n, _ in sizes for v in (b, max(1, -(-n // PART)))])[F.col("block")] if sizes else F.lit(1)
    rows = dealt.withColumn("part", F.pmod(F.xxhash64("doc_id"), parts).cast("int")).select("block", "part", "doc_id", "unit")
    return Blocked(rows, c.tolist(), sizes)


def _visits(queries: DataFrame, of: Blocked, k: int, first: bool) -> DataFrame:
    """query_id, unit and block of the blocks that a query visits: first the nearest with ``k`` rows together, then (with ``kth``) those that the limit allows."""
    import numpy as np

    c = np.array(of.centroids, np.float64)
    around = [b for b in of.blocks if b[0] >= 0]
    n, radius, number = np.array([b[1] for b in around]), np.array([b[2] for b in around]), np.array([b[0] for b in around], np.int64)
    always = [b[0] for b in of.blocks if b[0] < 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            u, has = _unit(b.column(1))
            apart = np.sqrt(np.maximum(2 - 2 * (u @ c[number].T), 0)) if len(around) else np.zeros((len(u), 0))
            order = np.argsort(apart - radius, axis=1, kind="stable")
            before = np.cumsum(n[order], axis=1) - n[order] if len(around) else np.zeros((len(u), 0))
            early = np.zeros(apart.shape, bool)
            np.put_along_axis(early, order, before < k, axis=1)
            if first:
                go = early & has[:, None]
            else:
                kth = b.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                limit = np.where(np.isnan(kth) | ~has, np.inf, np.sqrt(np.maximum(2 - 2 * (kth - SLACK), 0)) + 1e-9)
                go = (apart - radius <= limit[:, None]) & ~(early & has[:, None])
            i, j = np.nonzero(go)
            block = number[j]
            if first and always:
                i, block = np.concatenate([i, np.repeat(np.arange(len(u)), len(always))]), np.concatenate([block, np.tile(always, len(u))])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), b.column(1).take(pa.array(i)), pa.array(block, pa.int32())], ["query_id", "unit", "block"])

    columns = ["query_id", "vector"] + ([] if first else ["kth"])
    return queries.select(*columns).mapInArrow(run, "query_id long, unit array<double>, block int")


def _met(visits: DataFrame, of: Blocked, k: int) -> DataFrame:
    """The k best rows (query_id, doc_id, score) of each query in each part that it visits."""
    sizes = {b: max(1, -(-n // PART)) for b, n, _ in of.blocks}
    dealt = visits.withColumn("g", F.floor(F.row_number().over(Window.partitionBy("block", F.pmod(F.xxhash64("query_id"), F.lit(64))).orderBy("query_id")) * 64 / GROUP))  # about GROUP queries of a block each
    dealt = _kept(dealt, "visits")
    groups = dealt.select(F.col("block").alias("of_block"), F.col("g").alias("of_g")).distinct()
    parts = F.create_map(*[F.lit(v) for b, m in sizes.items() for v in (b, m)])[F.col("block")] if sizes else F.lit(1)
    asked = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    held = of.rows.select(F.col("block").alias("of_block"), F.col("part").alias("of_part"), "doc_id", "unit").join(groups, "of_block")

    def meet(qs: pa.Table, cs: pa.Table) -> pa.Table:
        import numpy as np

        names = ["query_id", "doc_id", "score"]
        if not qs.num_rows or not cs.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        x, y = _unit(qs["unit"])[0], np.array(cs["unit"].to_pylist(), np.float64)
        ids, of_query = cs["doc_id"].to_numpy(), qs["query_id"].to_numpy()
        out = []
        for lo in range(0, len(x), 256):
            score = np.round(x[lo : lo + 256] @ y.T, 6)
            kth = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k] if score.shape[1] > k else np.full((len(score), 1), -np.inf)
            i, j = np.nonzero(score >= kth)
            by = np.lexsort((ids[j], -score[i, j], i))
            i, j = i[by], j[by]
            begin = np.searchsorted(i, i)
            top = np.arange(len(i)) - begin < k
            out.append((of_query[lo + i[top]], ids[j[top]], score[i[top], j[top]]))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], names=names)

    return asked.groupBy("block", "part", "g").cogroup(held.groupBy("of_block", "of_part", "of_g")).applyInArrow(meet, "query_id long, doc_id long, score double")


def query_corpus(queries: DataFrame, corpus: DataFrame | Blocked, k: int = 8) -> tuple[DataFrame, DataFrame]:
    """query_id, rank, doc_id and score of the k best; and query_id, n_blocks and n_visited. ``queries``: query_id, vector, ids different."""
    if k <= 0:
        raise ValueError("k must be positive")
    of = corpus if isinstance(corpus, Blocked) else block_corpus(corpus)
    asked = queries.where("vector is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    one = _kept(_visits(asked, of, k, True), "first-visits")
    found = _kept(_met(one, of, k), "first-found")
    best = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
    kth = best(found).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    two = _kept(_visits(asked.join(kth, "query_id", "left"), of, k, False), "other-visits")
    top = best(found.union(_met(two, of, k))).select("query_id", "rank", "doc_id", "score")
    visited = one.select("query_id").union(two.select("query_id")).groupBy("query_id").agg(F.count("*").alias("n_visited"))
    told = asked.select("query_id").join(visited, "query_id", "left").select("query_id", F.lit(len(of.blocks)).cast("long").alias("n_blocks"), F.coalesce("n_visited", F.lit(0)).cast("long").alias("n_visited"))
    return top, told
