"""Exact vector top-k, its filtered and fallback forms, merging, reranking and context rendering."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.sources.io import work_dir

#: Rows of the corpus and queries of a block: one block pair is a small matrix product.
CORPUS_BLOCK = 4_096
QUERY_BLOCK = 512
#: Queries and rows of the corpus in a block of a bucket.
ANN_QUERIES = 4_096
ANN_CORPUS = 8_192


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int = 8, same: str | None = None) -> DataFrame:
    """query_id, rank, doc_id, score: the k best by cosine (6 decimals, ties by id).

    ``queries``: query_id, vector; ``corpus``: doc_id, vector. With ``same``, a column of both, only rows
    with an equal value count. Blocks of queries meet blocks of the corpus, so that no side is broadcast
    and a hot value of ``same`` is spread; a block pair returns k rows for each query at most.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    import numpy as np

    n_corpus, n_queries = corpus.count(), queries.count()
    threads = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks, blocks = max(-(-n_corpus // CORPUS_BLOCK), min(threads, n_corpus // 256)) or 1, -(-n_queries // QUERY_BLOCK) or 1
    extra = [same] if same else []
    c = corpus.select(F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).alias("c"), "doc_id", F.col("vector").cast("array<double>").alias("vector"), *extra)
    q = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("b"), "query_id", F.col("vector").cast("array<double>").alias("vector"), *extra)
    c = c.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    q = q.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))

    def unit(t: pa.Table):
        x = np.array(t["vector"].to_pylist(), np.float64)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def meet(qs: pa.Table, cs: pa.Table) -> pa.Table:
        names = ["query_id", "doc_id", "score"]
        if not qs.num_rows or not cs.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        score = np.round(unit(qs) @ unit(cs).T, 6)
        kth = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k] if score.shape[1] > k else -np.inf
        i, j = np.nonzero((score >= kth) & (score > -np.inf))
        ids, s = cs["doc_id"].to_numpy()[j], score[i, j]
        by = np.lexsort((ids, -s, i))
        i, ids, s = i[by], ids[by], s[by]
        start = np.concatenate(([0], np.flatnonzero(i[1:] != i[:-1]) + 1)) if len(i) else np.zeros(0, np.int64)
        place = np.arange(len(i)) - np.repeat(start, np.diff(np.concatenate((start, [len(i)]))))
        top = place < k
        return pa.Table.from_arrays([pa.array(qs["query_id"].to_numpy()[i[top]], pa.int64()), pa.array(ids[top], pa.int64()), pa.array(s[top], pa.float64())], names)

    keys = ["b", "c", *extra]  # rows of other values never meet
    met = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(meet, "query_id long, doc_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def full_lists(ranking: DataFrame, k: int) -> DataFrame:
    """query_id of the lists of ``k`` rows or more."""
    return ranking.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("query_id")


def vector_topk_fallback(filtered: DataFrame, unfiltered: DataFrame, k: int = 8) -> DataFrame:
    """The filtered list of a query where it is full, else both lists merged; with ``fallback``."""
    enough = full_lists(filtered, k)
    kept = filtered.join(enough, "query_id", "left_semi").withColumn("fallback", F.lit(False))
    short_f = filtered.join(enough, "query_id", "left_anti")
    short_u = unfiltered.join(enough, "query_id", "left_anti")
    merged = merge_ranked(short_f, short_u, k).withColumn("fallback", F.lit(True))
    return kept.select(*merged.columns).union(merged)


def merge_ranked(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """One list of each query from two: an id's best score, the first list's row on ties, then the k best."""
    both = first.select("query_id", "doc_id", "score", F.lit(0).alias("part")).union(second.select("query_id", "doc_id", "score", F.lit(1).alias("part")))
    best = both.groupBy("query_id", "doc_id").agg(F.min(F.struct((-F.col("score")).alias("less"), "part")).alias("b"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("b.less", "b.part", "doc_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", (-F.col("b.less")).alias("score"))


def rerank(ranking: DataFrame, scores: DataFrame, n: int = 5, enabled: bool = True) -> DataFrame:
    """The n best of each query by an outside score (query_id, doc_id, score); ids it doesn't know go. Off: the first n."""
    if not enabled:
        return ranking.where(F.col("rank") <= n)
    met = rerank_join(ranking, scores)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "old"))
    return met.withColumn("rank", rank).where(F.col("rank") <= n).select("query_id", "rank", "doc_id", "score")


def _four(score: str) -> Column:
    """A score of six decimals in four, halves up, by whole numbers: formatting functions differ on halves."""
    n = F.floor((F.round(F.col(score) * 1_000_000).cast("long") + 50) / 100).cast("long")
    return F.concat(F.when(n < 0, "-").otherwise(""), F.floor(F.abs(n) / 10_000).cast("string"), F.lit("."), F.lpad((F.abs(n) % 10_000).cast("string"), 4, "0"))


#: Metadata that a chunk may lack, in order.
OPTIONAL = ["year", "bac_section", "exercise_type", "difficulty"]


def context_block(ranking: DataFrame, texts: DataFrame, n: int = 5) -> DataFrame:
    """query_id and the n best chunks in order, each with its metadata and whole text.

    ``texts``: doc_id, text, source, topic and any of ``OPTIONAL``; what is null is left out."""
    met = ranking.where(F.col("rank") <= n).join(texts, "doc_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    pair = lambda name, value: F.concat(F.lit(f"{name}="), value.cast("string"))
    known = [pair(c, F.col(c)) for c in OPTIONAL if c in texts.columns]
    said = F.concat_ws(", ", pair("source", F.col("source")), pair("topic", F.col("topic")), pair("score", _four("score")), *known)
    numbered = met.select("query_id", place.alias("place"), said.alias("said"), "text")
    chunk = F.concat_ws("\n", F.format_string("[REFERENCE %d]", "place"), F.concat(F.lit("Metadata: "), F.col("said")), F.lit("Content:"), F.coalesce("text", F.lit("")))
    made = numbered.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", chunk.alias("chunk")))).alias("rows"))
    return made.select("query_id", F.array_join(F.transform("rows", lambda r: r["chunk"]), "\n\n").alias("context"))


def metadata_filter(rows: DataFrame, **wanted: object) -> DataFrame:
    """Rows equal in every given column, before anything is scored; null, empty and zero ask for nothing."""
    for name, value in wanted.items():
        if value:
            rows = rows.where(F.col(name) == value)
    return rows


def rerank_join(ranking: DataFrame, scores: DataFrame) -> DataFrame:
    """Candidates that an outside model scored (query_id, doc_id, score), with that score in place of theirs."""
    return ranking.select("query_id", "doc_id", F.col("rank").alias("old")).join(scores, ["query_id", "doc_id"])


def rag_context(queries: DataFrame, blocks: DataFrame, enabled: bool = True) -> DataFrame:
    """Every query with its context, empty where there is none or retrieval is off."""
    if not enabled:
        return queries.select("query_id", F.lit("").alias("context"))
    return queries.select("query_id").join(blocks, "query_id", "left").select("query_id", F.coalesce("context", F.lit("")).alias("context"))


def vector_topk_ann(queries: DataFrame, corpus: DataFrame, k: int = 8, tables: int = 8, width: float = 1.2, seed: int = 7) -> DataFrame:
    """Approximate top-k: random-projection hashing on unit vectors, exact scores on what shares a bucket of any table. Vectors without a direction take no part.

    A bucket is dealt into blocks of its size; a block of queries meets one of the corpus in a matrix product and keeps k rows of each query."""
    import numpy as np
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    length = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, y: a + y * y))

    def made(df: DataFrame, name: str) -> DataFrame:
        v = df.select(name, F.col("vector").cast("array<double>").alias("v")).withColumn("long", length(F.col("v"))).where((F.col("long") > 0) & (F.col("long") < float("inf")))
        path = work_dir(df.sparkSession, f"unit-{name}")  # a table, as Spark moves filters behind what fails on rows that go
        v.select(name, F.transform("v", lambda x: x / F.when(F.col("long") > 0, F.col("long")).otherwise(1.0)).alias("u")).write.parquet(path)
        return df.sparkSession.read.schema(f"{name} long, u array<double>").parquet(path).withColumn("features", array_to_vector("u"))

    q, c = made(queries, "query_id"), made(corpus, "doc_id")
    names = ["query_id", "doc_id", "score"]
    if not c.head(1):
        return q.sparkSession.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    lsh = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=width, numHashTables=tables, seed=seed).fit(c)

    def hashed(df: DataFrame, name: str) -> DataFrame:
        each = lsh.transform(df).select(name, "u", F.posexplode("hashes").alias("t", "at"))
        return each.select(name, "u", "t", vector_to_array("at")[0].cast("long").alias("at"))

    def blocks(df: DataFrame, rows: int, name: str) -> DataFrame:
        return df.groupBy("t", "at").agg(F.ceil(F.count("*") / rows).alias(name))

    hq, hc = hashed(q, "query_id"), hashed(c, "doc_id")
    # a row for each bucket, of which a table has at most 2 / width + 2, as the vectors are of unit length
    sizes = F.broadcast(blocks(hq, ANN_QUERIES, "nq").join(blocks(hc, ANN_CORPUS, "nc"), ["t", "at"]))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    hq = hq.join(sizes, ["t", "at"]).withColumn("x", F.pmod(F.xxhash64("query_id"), "nq")).withColumn("y", every("nc"))
    hc = hc.join(sizes, ["t", "at"]).withColumn("y", F.pmod(F.xxhash64("doc_id"), "nc")).withColumn("x", every("nq"))

    def matrix(t: pa.Table):
        x = t["u"].combine_chunks()
        return x.flatten().to_numpy().reshape(t.num_rows, -1)

    def meet(qs: pa.Table, cs: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if qs.num_rows and cs.num_rows:
            of, ids, own, other = qs["query_id"].to_numpy(), cs["doc_id"].to_numpy(), matrix(qs), matrix(cs)
            by = np.argsort(ids)  # so that ties go to the smaller id
            ids, other = ids[by], other[by]
            for lo in range(0, len(of), QUERY_BLOCK):
                score = np.round(own[lo : lo + QUERY_BLOCK] @ other.T, 6)
                kth = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k] if len(ids) > k else -np.inf
                i, j = np.nonzero(score >= kth)
                order = np.lexsort((j, -score[i, j], i))
                i, j = i[order], j[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                found.append((of[lo + i[place < k]], ids[j[place < k]], score[i, j][place < k]))
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names)

    keys = ["t", "at", "x", "y"]
    met = hq.select("query_id", "u", *keys).groupBy(*keys).cogroup(hc.select("doc_id", "u", *keys).groupBy(*keys)).applyInArrow(meet, "query_id long, doc_id long, score double")
    best = met.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))  # a pair may share the buckets of several tables
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
