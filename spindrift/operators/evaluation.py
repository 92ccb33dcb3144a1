"""Group-aware ranking metrics, comparison of two rankings, latency statistics and roll-ups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators.novelty import _kept


@dataclass(frozen=True)
class Grouped:
    """Labels of queries by groups of documents that queries share: ``groups`` (query_id, group_id, grade, member) and ``members`` (member, doc_id).

    It says what the table query_id, group_id, grade, doc_id says, which has a row for each query and document of a group."""

    groups: DataFrame
    members: DataFrame


def _labelled(rows: DataFrame, qrels: DataFrame | Grouped) -> DataFrame:
    """``rows`` (query_id, rank, doc_id) that are labelled for their query, with group and grade."""
    if isinstance(qrels, DataFrame):
        return rows.join(qrels, ["query_id", "doc_id"])
    # a row meets its document's groups first, so no table of queries by documents is made
    return rows.join(qrels.members, "doc_id").join(qrels.groups, ["query_id", "member"]).drop("member")


def group_claims(ranking: DataFrame, qrels: DataFrame | Grouped, k: int) -> DataFrame:
    """Relevant rows of the first k, each with ``claims``: whether it is the first of its group."""
    hits = _labelled(ranking.where(F.col("rank") <= k).select("query_id", "rank", "doc_id"), qrels)
    first = F.row_number().over(Window.partitionBy("query_id", "group_id").orderBy("rank")) == 1
    return hits.select("query_id", "rank", "doc_id", "group_id", "grade", first.alias("claims"))


def qrels_join(ranking: DataFrame, qrels: DataFrame | Grouped) -> DataFrame:
    """Every row of a ranking with its group and grade, null where the document is not labelled for the query."""
    if isinstance(qrels, Grouped):
        ranking = _kept(ranking.select("query_id", "rank", "doc_id"), "ranking")  # it stands on both sides of the join
        qrels = _labelled(ranking.select("query_id", "doc_id").distinct(), qrels)
    return ranking.select("query_id", "rank", "doc_id").join(qrels, ["query_id", "doc_id"], "left").select("query_id", "rank", "doc_id", "group_id", "grade")


def ranking_metrics(ranking: DataFrame, qrels: DataFrame | Grouped, queries: DataFrame, k: int) -> DataFrame:
    """recall, mrr, ndcg, raw hits, duplicate hits and matched groups in order, for every query."""
    if k <= 0:
        raise ValueError("k must be positive")
    claims = group_claims(ranking, qrels, k)
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1.0)
    got = claims.groupBy("query_id").agg(
        F.count("*").alias("raw_hits"),
        F.count_if(~F.col("claims")).alias("duplicate_hits"),
        F.count_if("claims").alias("n_claimed"),
        F.min("rank").alias("first"),
        F.sum(F.when(F.col("claims"), gain).otherwise(0.0)).alias("dcg"),
        F.array_sort(F.collect_list(F.when(F.col("claims"), F.struct("rank", "group_id")))).alias("order"),
    )
    named = qrels if isinstance(qrels, DataFrame) else qrels.groups.join(qrels.members.select("member").distinct(), "member", "left_semi")
    groups = named.select("query_id", "group_id", "grade").distinct()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "group_id"))
    ideal = groups.withColumn("place", place).groupBy("query_id").agg(F.count("*").alias("n_groups"), F.sum(F.when(F.col("place") <= k, (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("place") + 1.0)).otherwise(0.0)).alias("best"))
    met = queries.select("query_id").join(ideal, "query_id", "left").join(got, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return met.select(
        "query_id",
        zero(F.col("n_claimed") / F.col("n_groups")).alias("recall"),
        zero(1.0 / F.col("first")).alias("mrr"),
        F.when(F.col("best") > 0, F.round(zero(F.col("dcg")) / F.col("best"), 9)).otherwise(0.0).alias("ndcg"),
        F.coalesce("raw_hits", F.lit(0)).alias("raw_hits"),
        F.coalesce("duplicate_hits", F.lit(0)).alias("duplicate_hits"),
        F.coalesce(F.array_join(F.transform("order", lambda r: r["group_id"]), ","), F.lit("")).alias("matched"),
    )


def unknown_qrels(qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    return qrels.select("doc_id").distinct().join(corpus.select("doc_id"), "doc_id", "left_anti")


def ab_outcome(base: DataFrame, other: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """query_id and how ``other`` compares by ndcg."""
    met = base.select("query_id", F.col("ndcg").alias("base_ndcg")).join(other.select("query_id", F.col("ndcg").alias("other_ndcg")), "query_id")
    delta = F.col("other_ndcg") - F.col("base_ndcg")
    return met.withColumn("outcome", F.when(delta > tolerance, "improved").when(delta < -tolerance, "degraded").otherwise("unchanged"))


def metric_rollup(results: DataFrame) -> DataFrame:
    """Macro averages and outcome counts by topic and (topic null, is_total) overall."""
    return results.groupingSets([[F.col("topic")], []], F.col("topic")).agg(
        F.grouping("topic").cast("int").alias("is_total"), F.count("*").alias("n_queries"),
        F.round(F.avg("recall"), 9).alias("recall"), F.round(F.avg("mrr"), 9).alias("mrr"), F.round(F.avg("ndcg"), 9).alias("ndcg"),
        F.count_if(F.col("outcome") == "improved").alias("improved"), F.count_if(F.col("outcome") == "degraded").alias("degraded"), F.count_if(F.col("outcome") == "unchanged").alias("unchanged"),
    )


def latency_stats(samples: DataFrame, *keys: str) -> DataFrame:
    """n, mean, median, nearest-rank p95, least and most of ``value``; nulls are no samples. Without ``keys`` one row, of zeros where there are no samples.

    Different values are counted first and dealt by ranges of (keys, value), so that a group of any size lies in many tasks; a range's values before it are
    known from sums of ranges, and only rows at the wanted ranks go on. No task holds a group."""
    threads = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)] or [F.lit(0).alias("k0")]
    group = [f"k{i}" for i in range(len(by))]
    counted = samples.where("value is not null").select(*by, F.col("value").cast("double").alias("value")).groupBy(*group, "value").agg(F.count("*").alias("w"))
    dealt = _kept(counted.repartitionByRange(threads, *group, "value").withColumn("part", F.spark_partition_id()), "sample-counts")
    sums = dealt.groupBy(*group, "part").agg(F.sum("w").alias("m"))  # a row for each group and range
    upto = F.sum("m").over(Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")
    before = sums.select(*[F.col(c).alias(f"b_{c}") for c in group], F.col("part").alias("b_part"), upto.alias("before"), F.sum("m").over(Window.partitionBy(*group)).alias("n"))
    same = F.col("part") == F.col("b_part")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"b_{c}"))
    inside = F.sum("w").over(Window.partitionBy(*group, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    placed = dealt.withColumn("inside", inside).join(before, same).select(*group, "value", "w", "n", (F.col("inside") + F.col("before")).alias("last"))
    holds = lambda rank: (F.col("last") >= rank) & (F.col("last") - F.col("w") < rank)
    low, high, late = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1, F.floor((19 * F.col("n") + 19) / 20)
    at = lambda rank: F.max(F.when(holds(rank), F.col("value")))
    # sums of values by ranges, in the order of values, so that no order of rows changes them
    out = placed.groupBy(*group).agg(F.sum("w").alias("n"), F.round(F.sum(F.col("value") * F.col("w")) / F.sum("w"), 6).alias("mean"), ((at(low) + at(high)) / 2).alias("median"), at(late).alias("p95"), F.min("value").alias("least"), F.max("value").alias("most"))
    names = ["n", "mean", "median", "p95", "least", "most"]
    if keys:
        return out.select(*[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)], *names)
    return out.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in names[1:]])


METRICS = ["recall5", "mrr5", "ndcg5", "recall8", "rerank_recall5", "rerank_mrr5", "rerank_ndcg5"]
LATENCIES = ["retrieval", "reranker", "combined"]


def evaluation_report(results: DataFrame, failures: DataFrame) -> DataFrame:
    """The whole report by topic and (topic null, is_total 1) overall: how many queries succeeded and failed, ratios, averages of both rankings, outcomes, and latencies.

    ``results``: query_id, topic, ``METRICS``, outcome, and ``LATENCIES`` in milliseconds; ``failures``: query_id, topic, stage. Averages and latencies are zero where nothing succeeded."""
    results = _kept(results, "results")
    all_of = [[F.col("topic")], []]
    mark = F.grouping("topic").cast("int").alias("is_total")
    done = results.groupingSets(all_of, F.col("topic")).agg(
        mark, F.count("*").alias("successful"), *[F.round(F.avg(c), 9).alias(c) for c in METRICS],
        *[F.count_if(F.col("outcome") == x).alias(x) for x in ("improved", "degraded", "unchanged")],
    )
    lost = failures.groupingSets(all_of, F.col("topic")).agg(mark, F.count("*").alias("failed"))
    both = done.join(lost.withColumnsRenamed({"topic": "t", "is_total": "i"}), F.col("topic").eqNullSafe(F.col("t")) & (F.col("is_total") == F.col("i")), "full")
    topic, total = F.coalesce("topic", "t").alias("topic"), F.coalesce("is_total", "i").alias("is_total")
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    out = both.select(topic, total, *[zero(c, 0) for c in ("successful", "failed", "improved", "degraded", "unchanged")], *[zero(c, 0.0) for c in METRICS])
    n = F.col("successful") + F.col("failed")
    ratio = lambda c: F.when(n > 0, F.round(F.col(c) / n, 9)).otherwise(0.0)
    out = out.withColumns({"total_queries": n, "successful_ratio": ratio("successful"), "failed_ratio": ratio("failed")})
    spans = results.select("topic", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in LATENCIES])).alias("s")).select("topic", "s.kind", "s.value")
    wide = ["mean", "median", "p95", "least", "most"]

    def pivoted(stats: DataFrame, *keys: str) -> DataFrame:
        each = [F.coalesce(F.max(F.when(F.col("kind") == k, F.col(c))), F.lit(0.0)).alias(f"{k}_{c}") for k in LATENCIES for c in wide]
        return stats.groupBy(*keys).agg(*each)

    by_topic = pivoted(latency_stats(spans, "topic", "kind"), "topic").withColumn("i", F.lit(0))
    overall = pivoted(latency_stats(spans, "kind")).select(F.lit(None).cast(results.schema["topic"].dataType).alias("topic"), "*", F.lit(1).alias("i"))
    took = by_topic.unionByName(overall).withColumnRenamed("topic", "t")
    met = out.join(took, F.col("topic").eqNullSafe(F.col("t")) & (F.col("is_total") == F.col("i")), "left").drop("t", "i")
    return met.fillna(0.0, [f"{k}_{c}" for k in LATENCIES for c in wide])


def golden_checks(queries: DataFrame, qrels: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Violations of a labelled query set: rule, query_id, item.

    ``groups`` (query_id, group_id, n_documents) has one row for each group as it was written, which labels by document
    can't tell: a group that stands there twice in a query, and one without documents.
    """
    as_rule = lambda df, rule, q, item: df.select(F.lit(rule).alias("rule"), q.cast("string").alias("query_id"), item.cast("string").alias("item"))
    q, d, g = F.col("query_id"), F.col("doc_id"), F.col("group_id")
    parts = [
        as_rule(queries.groupBy("query_id").count().where("count > 1"), "duplicate_query", q, q),
        as_rule(qrels.groupBy("query_id", "doc_id").agg(F.countDistinct("group_id").alias("n")).where("n > 1"), "document_in_two_groups", q, d),
        as_rule(qrels.where("grade not between 1 and 3").select("query_id", "group_id").distinct(), "grade_out_of_range", q, g),
        as_rule(qrels.where("trim(group_id) = ''").select("query_id", "group_id").distinct(), "blank_label", q, g),
        as_rule(queries.select("query_id").distinct().join(qrels, "query_id", "left_anti"), "no_relevance", q, q),
    ]
    if groups is not None:
        parts += [
            as_rule(groups.groupBy("query_id", "group_id").count().where("count > 1"), "duplicate_group", q, g),
            as_rule(groups.where("coalesce(n_documents, 0) = 0").select("query_id", "group_id").distinct(), "no_documents", q, g),
        ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


#: What a run's environment must show beside its cases; the values that let it be released.
CONDITIONS = {"fail_open_succeeded": True, "fail_open_logged": True, "fail_closed_propagated": True, "fail_closed_calls": 0, "reranker_attempts": 0, "cleanup_completed": True}


def run_gate(cases: DataFrame, observed: dict[str, object], inserted: int, deleted: int) -> DataFrame:
    """One row: counts of case outcomes, the conditions that don't hold, and the decision.

    ``cases``: success, fallback, suspicious, context_non_empty, order_preserved. A run is released when no case failed or is suspicious, all have context and
    their order, ``observed`` equals ``CONDITIONS``, and what the run inserted was deleted. A null flag doesn't hold; no cases: their conditions hold."""
    if set(observed) != set(CONDITIONS):
        raise ValueError(f"observed must have {', '.join(CONDITIONS)}")
    off = lambda c: F.count_if(~F.coalesce(F.col(c), F.lit(False)))
    told = cases.agg(
        F.count("*").alias("n_cases"), off("success").alias("n_failed"), F.count_if("fallback").alias("n_fallback"), F.count_if(F.coalesce(F.col("suspicious"), F.lit(True))).alias("n_suspicious"),
        off("context_non_empty").alias("n_without_context"), off("order_preserved").alias("n_order_lost"),
    )
    against = [F.when(F.col(c) > 0, c) for c in ("n_failed", "n_suspicious", "n_without_context", "n_order_lost")]
    against += [F.lit(c) for c, want in CONDITIONS.items() if observed[c] != want] + ([F.lit("deleted_count")] if inserted != deleted else [])
    return told.withColumn("against", F.array_join(F.array_compact(F.array(*against)), ",")).withColumn("release", F.col("against") == "")


def index_preflight(vectors: DataFrame, expected: int, dimension: int, namespace: str, metric: str, expected_metric: str = "cosine") -> DataFrame:
    """One row: what an index holds and what differs from what is expected. ``vectors``: namespace, vector; ``metric``: what the index compares by."""
    found = vectors.agg(
        F.count("*").alias("n"), F.count_if(F.col("namespace").eqNullSafe(F.lit(namespace))).alias("n_namespace"), F.min(F.size("vector")).alias("least_dim"), F.max(F.size("vector")).alias("most_dim"),
        F.array_join(F.array_sort(F.collect_set(F.coalesce("namespace", F.lit("")))), ",").alias("namespaces"),
    )
    dims = (F.col("least_dim") != dimension) | (F.col("most_dim") != dimension) | F.col("least_dim").isNull()
    wrong = [F.when(dims, "dimension"), F.when(F.lit(metric) != expected_metric, "metric"), F.when(F.col("n_namespace") != expected, "namespace_vector_count"), F.when(F.col("n") != expected, "total_vector_count"), F.when(F.col("namespaces") != namespace, "namespaces")]
    return found.withColumn("mismatches", F.array_join(F.array_compact(F.array(*wrong)), ","))
