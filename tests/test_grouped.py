"""Labels by shared groups against the table of queries by documents, and searches made once."""

from pyspark.sql import functions as F

from spindrift.operators import evaluation as E


def test_grouped_labels_equal_the_whole_table(spark):
    groups = spark.createDataFrame([(1, "a", 3, 10), (1, "b", 1, 11), (2, "a", 2, 10), (2, "none", 3, 99), (3, "b", 1, 11)], "query_id long, group_id string, grade int, member int")
    members = spark.createDataFrame([(10, 1), (10, 2), (11, 2), (11, 3)], "member int, doc_id long")
    whole = groups.join(members, "member").select("query_id", "group_id", "grade", "doc_id")
    ranking = spark.createDataFrame([(q, r, d, 0.5) for q in (1, 2, 3) for r, d in enumerate((4, 2, 1, 3), 1)], "query_id long, rank int, doc_id long, score double")
    queries = spark.createDataFrame([(i,) for i in range(1, 5)], "query_id long")
    both = E.Grouped(groups, members)
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert rows(E.qrels_join(ranking, both)) == rows(E.qrels_join(ranking, whole))
    assert rows(E.ranking_metrics(ranking, both, queries, 3)) == rows(E.ranking_metrics(ranking, whole, queries, 3))
    one = ranking.where("query_id <> 1")  # no two groups of one document, whose order is open
    assert rows(E.group_claims(one, both, 3)) == rows(E.group_claims(one, whole, 3))


def test_queries_search_once(spark, monkeypatch):
    from spindrift.operators import retrieval as R
    from spindrift.plans import queries as Q

    calls, search = [], R.vector_topk
    found = {}

    def counted(q, c, k=8, same=None):
        calls.append(q.count())
        return search(q, c, k, same)

    monkeypatch.setattr(R, "vector_topk", counted)
    d = "/root/testdata/sf0.001"
    for name in ("evaluate_run", "ab_outcome", "metric_rollup"):
        df = Q.QUERIES[name](spark, d)
        found[name] = df._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroups" not in found[name], name
    calls.clear()
    Q.QUERIES["vector_topk_fallback"](spark, d).count()
    assert len(calls) == 2
    n = spark.read.parquet(f"{d}/embeddings.parquet")
    few = n.groupBy("label").agg(F.count("*").alias("n")).where("n < 60").select("label")
    assert calls[1] == n.where("vec_id % 20 = 0").join(few, "label", "left_semi").count()
