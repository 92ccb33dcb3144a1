"""The operators bound to the driver's tables: queries by name, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import corpus as C
from spindrift.operators import evaluation as E
from spindrift.operators import hooks as H
from spindrift.operators import novelty as N
from spindrift.operators import progress as P
from spindrift.operators import pruned
from spindrift.operators import ratelimit as L
from spindrift.operators import retrieval as R
from spindrift.plans import corpus_queries, record_queries
from spindrift.sources import io
from spindrift.sources.store import Store
from spindrift.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- retrieval and ranking evaluation: embeddings, label as topic, every 20th id a query


def _vectors(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = read(s, d, "embeddings")
    corpus = v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")
    return v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label"), corpus


def _qrels(s: SparkSession, d: str) -> E.Grouped:
    """Group by (query, label): grade 3 for the query's label, 1 for the next one."""
    q, c = _vectors(s, d)
    want = q.select("query_id", F.explode(F.array(F.struct(F.col("label").alias("member"), F.lit(3).alias("grade")), F.struct(((F.col("label") + 1) % 10).alias("member"), F.lit(1).alias("grade")))).alias("g")).select("query_id", "g.*")
    return E.Grouped(want.withColumn("group_id", F.concat(F.lit("g"), F.col("member"))), c.select(F.col("label").alias("member"), "doc_id"))


_FOUR = "(SELECT CASE WHEN n < 0 THEN '-' ELSE '' END || (abs(n) // 10000) || '.' || lpad((abs(n) % 10000)::VARCHAR, 4, '0') FROM (SELECT floor((round(score * 1000000)::BIGINT + 50) / 100)::BIGINT AS n))"
_TOP = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id AS doc_id, q.label AS ql, e.label AS dl, round(list_cosine_similarity(v, embedding::DOUBLE[]), 6) AS score FROM q, embeddings e),
top AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s),
ftop AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE ql = dl),
rr AS (SELECT query_id, doc_id, rank AS old, round(((doc_id * 7919) % 1000) / 1000.0, 6)::DOUBLE AS score FROM top WHERE rank <= 8),
re AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old)::INTEGER AS rank, doc_id, score FROM rr),
qrels AS (SELECT query_id, 'g' || e.label AS group_id, CASE WHEN e.label = q.label THEN 3 ELSE 1 END AS grade, vec_id AS doc_id FROM q JOIN embeddings e ON e.label = q.label OR e.label = (q.label + 1) % 10)"""


def _metric_sql(name: str, ranking: str, k: int) -> str:
    return f"""
{name}h AS (SELECT r.query_id, rank, group_id, grade, row_number() OVER (PARTITION BY r.query_id, group_id ORDER BY rank) = 1 AS claims
      FROM {ranking} r JOIN qrels USING (query_id, doc_id) WHERE rank <= {k}),
{name}g AS (SELECT query_id, count(*) AS raw, count(*) FILTER (NOT claims) AS dup, count(*) FILTER (claims) AS got, min(rank) AS first,
      sum((pow(2, grade) - 1) / log2(rank + 1)) FILTER (claims) AS dcg, string_agg(group_id, ',' ORDER BY rank) FILTER (claims) AS matched FROM {name}h GROUP BY 1),
{name}i AS (SELECT query_id, count(*) AS n, sum((pow(2, grade) - 1) / log2(p + 1)) FILTER (p <= {k}) AS best
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, group_id) AS p FROM (SELECT DISTINCT query_id, group_id, grade FROM qrels)) GROUP BY 1),
{name} AS (SELECT q.query_id, coalesce(got / n, 0)::DOUBLE AS recall, coalesce(1.0 / first, 0)::DOUBLE AS mrr, coalesce(round(coalesce(dcg, 0) / best, 9), 0)::DOUBLE AS ndcg,
      coalesce(raw, 0)::BIGINT AS raw_hits, coalesce(dup, 0)::BIGINT AS duplicate_hits, coalesce(matched, '') AS matched FROM q LEFT JOIN {name}i USING (query_id) LEFT JOIN {name}g USING (query_id))"""


@query(f"WITH {_TOP} SELECT * FROM top WHERE rank <= 8")
def vector_topk(s, d):
    return R.vector_topk(*_vectors(s, d))


@query(f"WITH {_TOP} SELECT * FROM ftop WHERE rank <= 8")
def vector_topk_filtered(s, d):
    return R.vector_topk(*_vectors(s, d), same="label")


@query("SELECT doc_id, source FROM documents WHERE lang = 'de'")
def metadata_filter(s, d):
    return R.metadata_filter(read(s, d, "documents"), lang="de", source="").select("doc_id", "source")


@query(f"""WITH {_TOP}, n AS (SELECT query_id, count(*) AS n FROM ftop WHERE rank <= 60 GROUP BY 1),
    m AS (SELECT query_id, doc_id, score, 0 AS part FROM ftop WHERE rank <= 60 UNION ALL SELECT query_id, doc_id, score, 1 FROM top WHERE rank <= 60),
    b AS (SELECT query_id, doc_id, max(score) AS score, min(part) AS part FROM m GROUP BY ALL),
    r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, part, doc_id)::INTEGER AS rank, doc_id, score FROM b)
    SELECT query_id, rank, doc_id, score, false AS fallback FROM ftop JOIN n USING (query_id) WHERE n >= 60 AND rank <= 60
    UNION ALL SELECT query_id, rank, doc_id, score, true FROM r WHERE rank <= 60 AND query_id NOT IN (SELECT query_id FROM n WHERE n >= 60)""")
def vector_topk_fallback(s, d):
    q, c = _vectors(s, d)
    own = N._kept(R.vector_topk(q, c, 60, same="label"), "filtered")
    # only the others fall back, so only they are searched for in everything
    others = q.join(R.full_lists(own, 60), "query_id", "left_anti")
    return R.vector_topk_fallback(own, R.vector_topk(others, c, 60), 60)


@query(f"""WITH {_TOP}, m AS (SELECT query_id, doc_id, score, 0 AS part FROM ftop WHERE rank <= 8 UNION ALL SELECT query_id, doc_id, score, 1 FROM top WHERE rank <= 8),
    b AS (SELECT query_id, doc_id, max(score) AS score, min(part) AS part FROM m GROUP BY ALL)
    SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, part, doc_id)::INTEGER AS rank, doc_id, score FROM b) WHERE rank <= 8""")
def merge_ranked(s, d):
    q, c = _vectors(s, d)
    return R.merge_ranked(R.vector_topk(q, c, same="label"), R.vector_topk(q, c), 8)


@query()
def vector_topk_ann(s, d):
    return R.vector_topk_ann(*_vectors(s, d))


def _reranked(top: DataFrame) -> DataFrame:
    scores = top.select("query_id", "doc_id", F.round(((F.col("doc_id") * 7919) % 1000) / 1000.0, 6).alias("score"))
    return R.rerank(top, scores)


@query(f"WITH {_TOP} SELECT * FROM re WHERE rank <= 5")
def rerank(s, d):
    return _reranked(R.vector_topk(*_vectors(s, d)))


@query(f"WITH {_TOP} SELECT query_id, doc_id, rank AS old, round(((doc_id * 7919) % 1000) / 1000.0, 6)::DOUBLE AS score FROM top WHERE rank <= 8 AND doc_id % 3 <> 0")
def rerank_join(s, d):
    """Every third document is unknown to the outside model and goes."""
    top = R.vector_topk(*_vectors(s, d))
    scores = top.where("doc_id % 3 <> 0").select("query_id", "doc_id", F.round(((F.col("doc_id") * 7919) % 1000) / 1000.0, 6).alias("score"))
    return R.rerank_join(top, scores)


def _chunks(place: str) -> str:
    meta = f"concat_ws(', ', 'source=src' || doc_id % 7, 'topic=' || e.label, 'score=' || {_FOUR}, 'year=' || (2000 + doc_id % 9), CASE WHEN e.label <> 0 THEN 'difficulty=' || e.label END)"
    return f"string_agg(concat_ws(chr(10), '[REFERENCE ' || {place} || ']', 'Metadata: ' || {meta}, 'Content:', 'text ' || doc_id), chr(10) || chr(10) ORDER BY rank)"


def _texts(c: DataFrame) -> DataFrame:
    """Chunks of vectors: every text and year from the id, no difficulty for label 0."""
    k, label = F.col("doc_id"), F.col("label").cast("string")
    return c.select("doc_id", F.concat(F.lit("text "), k).alias("text"), F.concat(F.lit("src"), k % 7).alias("source"), label.alias("topic"), (2000 + k % 9).alias("year"), F.when(F.col("label") != 0, label).alias("difficulty"))


@query(f"WITH {_TOP} SELECT query_id, {_chunks('rank')} AS context FROM top JOIN embeddings e ON e.vec_id = doc_id WHERE rank <= 5 GROUP BY 1")
def context_block(s, d):
    q, c = _vectors(s, d)
    return R.context_block(R.vector_topk(q, c), _texts(c))


@query(f"""WITH {_TOP}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM top WHERE rank <= 5 AND score >= 0.35 AND doc_id <> query_id)
    SELECT q.query_id, coalesce(c, '') AS context FROM q LEFT JOIN (SELECT query_id, {_chunks('place')} AS c FROM p JOIN embeddings e ON e.vec_id = doc_id GROUP BY 1) USING (query_id)""")
def rag_context(s, d):
    q, c = _vectors(s, d)
    good = R.vector_topk(q, c).where("score >= 0.35 and doc_id <> query_id")
    return R.rag_context(q, R.context_block(good, _texts(c)))


@query(f"WITH {_TOP},{_metric_sql('m', 'top', 5)} SELECT query_id, rank, group_id, grade, claims, doc_id FROM mh JOIN top USING (query_id, rank)")
def group_claims(s, d):
    return E.group_claims(R.vector_topk(*_vectors(s, d)), _qrels(s, d), 5)


def _metrics(s, d, k, ranking=None):
    q, c = _vectors(s, d)
    return E.ranking_metrics(ranking or R.vector_topk(q, c), _qrels(s, d), q, k)


@query(f"WITH {_TOP},{_metric_sql('m', 'top', 5)} SELECT * FROM m")
def ranking_metrics(s, d):
    return _metrics(s, d, 5)


for _name, _k in (("recall", 8), ("mrr", 5), ("ndcg", 5)):
    QUERIES[f"{_name}_at_k"] = lambda s, d, c=_name, k=_k: _metrics(s, d, k).select("query_id", c)
    SQL[f"{_name}_at_k"] = f"WITH {_TOP},{_metric_sql('m', 'top', _k)} SELECT query_id, {_name} FROM m"

@query(f"WITH {_TOP} SELECT query_id, rank, doc_id, group_id, grade FROM top LEFT JOIN qrels USING (query_id, doc_id) WHERE rank <= 8")
def qrels_join(s, d):
    return E.qrels_join(R.vector_topk(*_vectors(s, d)), _qrels(s, d))


_AB = f"WITH {_TOP},{_metric_sql('m', 'top', 5)},{_metric_sql('n', 're', 5)}, ab AS (SELECT m.query_id, m.ndcg AS base_ndcg, n.ndcg AS other_ndcg, CASE WHEN n.ndcg - m.ndcg > 1e-9 THEN 'improved' WHEN n.ndcg - m.ndcg < -1e-9 THEN 'degraded' ELSE 'unchanged' END AS outcome FROM m JOIN n USING (query_id))"


@query(f"{_AB} SELECT * FROM ab")
def ab_outcome(s, d):
    top = N._kept(R.vector_topk(*_vectors(s, d)), "top")
    return E.ab_outcome(_metrics(s, d, 5, top), _metrics(s, d, 5, _reranked(top)))


@query(f"""{_AB} SELECT label AS topic, grouping(label)::INTEGER AS is_total, count(*) AS n_queries, round(avg(recall), 9) AS recall, round(avg(mrr), 9) AS mrr, round(avg(m.ndcg), 9) AS ndcg,
    count(*) FILTER (outcome = 'improved') AS improved, count(*) FILTER (outcome = 'degraded') AS degraded, count(*) FILTER (outcome = 'unchanged') AS unchanged
    FROM m JOIN ab USING (query_id) JOIN q USING (query_id) GROUP BY GROUPING SETS ((label), ())""")
def metric_rollup(s, d):
    q, c = _vectors(s, d)
    top = N._kept(R.vector_topk(q, c), "top")
    base = _metrics(s, d, 5, top)
    ab = E.ab_outcome(base, _metrics(s, d, 5, _reranked(top)))
    return E.metric_rollup(base.join(ab.select("query_id", "outcome"), "query_id").join(q.select("query_id", F.col("label").alias("topic")), "query_id"))


@query(f"""WITH {_TOP},{_metric_sql('m', 'top', 5)},{_metric_sql('e', 'top', 8)},{_metric_sql('n', 're', 5)}
    SELECT query_id, m.recall AS recall5, m.mrr AS mrr5, m.ndcg AS ndcg5, e.recall AS recall8, n.recall AS rerank_recall5, n.mrr AS rerank_mrr5, n.ndcg AS rerank_ndcg5 FROM m JOIN e USING (query_id) JOIN n USING (query_id)""")
def evaluate_run(s, d):
    top = N._kept(R.vector_topk(*_vectors(s, d)), "top")
    five = _metrics(s, d, 5, top).select("query_id", F.col("recall").alias("recall5"), F.col("mrr").alias("mrr5"), F.col("ndcg").alias("ndcg5"))
    eight = _metrics(s, d, 8, top).select("query_id", F.col("recall").alias("recall8"))
    again = _metrics(s, d, 5, _reranked(top)).select("query_id", F.col("recall").alias("rerank_recall5"), F.col("mrr").alias("rerank_mrr5"), F.col("ndcg").alias("rerank_ndcg5"))
    return five.join(eight, "query_id").join(again, "query_id")


#: In the report of the query, latencies come from ids, and every third query fails at the reranker.
_TOOK = {"retrieval": "((query_id * 37) % 1000) / 10.0", "reranker": "((query_id * 91) % 500) / 10.0", "combined": "((query_id * 37) % 1000) / 10.0 + ((query_id * 91) % 500) / 10.0"}
_SPANS = ", ".join(f"coalesce(round(avg({k}), 6), 0)::DOUBLE AS {k}_mean, coalesce(median({k}), 0)::DOUBLE AS {k}_median, coalesce(quantile_disc({k}, 0.95), 0)::DOUBLE AS {k}_p95, coalesce(min({k}), 0)::DOUBLE AS {k}_least, coalesce(max({k}), 0)::DOUBLE AS {k}_most" for k in _TOOK)


@query(f"""{_AB}, {_metric_sql('e', 'top', 8)[1:]},
    told AS (SELECT q.label AS topic, query_id % 60 = 0 AS lost, m.recall AS recall5, m.mrr AS mrr5, m.ndcg AS ndcg5, e.recall AS recall8, n.recall AS rerank_recall5, n.mrr AS rerank_mrr5, n.ndcg AS rerank_ndcg5, outcome,
      {', '.join(f'({v})::DOUBLE AS {k}' for k, v in _TOOK.items())} FROM q JOIN m USING (query_id) JOIN e USING (query_id) JOIN n USING (query_id) JOIN ab USING (query_id)),
    sound AS (SELECT topic, lost, outcome, {', '.join(f'CASE WHEN NOT lost THEN {c} END AS {c}' for c in [*E.METRICS, *_TOOK])} FROM told)
    SELECT topic, grouping(topic)::INTEGER AS is_total, count(*) FILTER (NOT lost) AS successful, count(*) FILTER (lost) AS failed, count(*) AS total_queries, round(count(*) FILTER (NOT lost) / count(*), 9) AS successful_ratio, round(count(*) FILTER (lost) / count(*), 9) AS failed_ratio,
      {', '.join(f"count(*) FILTER (NOT lost AND outcome = '{x}') AS {x}" for x in ('improved', 'degraded', 'unchanged'))}, {', '.join(f'coalesce(round(avg({c}), 9), 0)::DOUBLE AS {c}' for c in E.METRICS)}, {_SPANS} FROM sound GROUP BY GROUPING SETS ((topic), ())""")
def full_report(s, d):
    q, c = _vectors(s, d)
    top = N._kept(R.vector_topk(q, c), "top")
    again = N._kept(_reranked(top), "reranked")
    base, other = _metrics(s, d, 5, top), _metrics(s, d, 5, again)
    named = lambda df, **names: df.select("query_id", *[F.col(v).alias(k) for k, v in names.items()])
    met = named(base, recall5="recall", mrr5="mrr", ndcg5="ndcg").join(named(_metrics(s, d, 8, top), recall8="recall"), "query_id").join(named(other, rerank_recall5="recall", rerank_mrr5="mrr", rerank_ndcg5="ndcg"), "query_id")
    met = met.join(E.ab_outcome(base, other).select("query_id", "outcome"), "query_id").join(q.select("query_id", F.col("label").alias("topic")), "query_id")

    def rerank_all(ids: list) -> list:
        if any(i % 60 == 0 for i in ids):
            raise RuntimeError("no answer")
        return [((i * 91) % 500) / 10.0 for i in ids]

    made = H.hooked(met, "query_id", "reranker", "double", rerank_all, "reranker", on_error="capture")
    failures = made.where("error is not null").select("query_id", "topic", "error.stage")
    took = made.where("error is null").drop("error").withColumns({"retrieval": F.expr("cast(((query_id * 37) % 1000) / 10.0 as double)")}).withColumn("combined", F.col("retrieval") + F.col("reranker"))
    return E.evaluation_report(took, failures)


@query(f"WITH {_TOP} SELECT * FROM top WHERE rank <= 8")
def query_corpus(s, d):
    return pruned.query_corpus(*_vectors(s, d))[0]


def _asking(s, d):
    """Documents as queries; the retriever fails for every third."""
    def retrieve(texts: list) -> list:
        if any(int(t) % 3 == 0 for t in texts):
            raise ConnectionError("index is away")
        return [f"context of {t}" for t in texts]

    return read(s, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("doc_id").cast("string").alias("text")), retrieve


@query("SELECT doc_id AS query_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'context of ' || doc_id END AS context FROM documents")
def rag_context_fail_open(s, d):
    return H.provided_context(*_asking(s, d))[0]


@query("SELECT doc_id AS query_id, 'retrieval' AS stage, 'ConnectionError: index is away' AS message FROM documents WHERE doc_id % 3 = 0")
def dead_letters(s, d):
    return H.provided_context(*_asking(s, d))[1]


@query("SELECT count(value) AS n, round(avg(value), 6) AS mean, median(value) AS median, quantile_disc(value, 0.95) AS p95, min(value) AS least, max(value) AS most FROM events")
def latency_overall(s, d):
    return E.latency_stats(read(s, d, "events"))


@query("SELECT DISTINCT vec_id + 3 AS doc_id FROM embeddings WHERE vec_id + 3 NOT IN (SELECT vec_id FROM embeddings)")
def unknown_qrels(s, d):
    _, c = _vectors(s, d)
    return E.unknown_qrels(c.select((F.col("doc_id") + 3).alias("doc_id")), c)


@query("""SELECT 'grade_out_of_range' AS rule, doc_id::VARCHAR AS query_id, 'g' || quality AS item FROM labels WHERE quality = 0
    UNION ALL SELECT 'no_relevance', doc_id::VARCHAR, doc_id::VARCHAR FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT 'duplicate_group', doc_id::VARCHAR, 'g' || quality FROM labels WHERE toxic = 1 UNION ALL SELECT 'no_documents', doc_id::VARCHAR, 'g' || quality FROM labels WHERE quality = 1 AND toxic = 1""")
def golden_checks(s, d):
    """Labels as a labelled set: a toxic document's group stands there twice, once without documents where its quality is good."""
    lab = read(s, d, "labels")
    q, g = F.col("doc_id").alias("query_id"), F.concat(F.lit("g"), F.col("quality")).alias("group_id")
    groups = lab.select(q, g, F.lit(1).alias("n")).union(lab.where("toxic = 1").select(q, g, (1 - F.col("quality")).cast("int")))
    return E.golden_checks(read(s, d, "documents").select(q), lab.select(q, g, F.col("quality").alias("grade"), "doc_id"), groups.withColumnRenamed("n", "n_documents"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, median(value) AS median, quantile_disc(value, 0.95) AS p95, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def latency_stats(s, d):
    return E.latency_stats(read(s, d, "events"), "event_type")


@query("""SELECT *, concat_ws(',', CASE WHEN n_failed > 0 THEN 'n_failed' END, CASE WHEN n_suspicious > 0 THEN 'n_suspicious' END, CASE WHEN n_without_context > 0 THEN 'n_without_context' END, CASE WHEN n_order_lost > 0 THEN 'n_order_lost' END, 'fail_closed_calls') AS against, false AS release
    FROM (SELECT count(*) AS n_cases, count(*) FILTER (value < 20) AS n_failed, count(*) FILTER (event_type = 'click') AS n_fallback, count(*) FILTER (value < 0) AS n_suspicious, count(*) FILTER (user_id % 50 = 0) AS n_without_context, count(*) FILTER (event_id < 0) AS n_order_lost FROM events)""")
def run_gate(s, d):
    e = read(s, d, "events")
    cases = e.select((F.col("value") >= 20).alias("success"), (F.col("event_type") == "click").alias("fallback"), (F.col("value") < 0).alias("suspicious"), (F.col("user_id") % 50 != 0).alias("context_non_empty"), (F.col("event_id") >= 0).alias("order_preserved"))
    return E.run_gate(cases, E.CONDITIONS | {"fail_closed_calls": 1}, 3, 3)


@query("""SELECT *, concat_ws(',', CASE WHEN least_dim <> 768 OR most_dim <> 768 THEN 'dimension' END, CASE WHEN n_namespace <> 500 THEN 'namespace_vector_count' END, CASE WHEN n <> 500 THEN 'total_vector_count' END, CASE WHEN namespaces <> 'l3' THEN 'namespaces' END) AS mismatches
    FROM (SELECT count(*) AS n, count(*) FILTER (label = 3) AS n_namespace, min(len(embedding))::INTEGER AS least_dim, max(len(embedding))::INTEGER AS most_dim, string_agg(DISTINCT 'l' || label, ',' ORDER BY 'l' || label) AS namespaces FROM embeddings)""")
def index_preflight(s, d):
    return E.index_preflight(_vectors(s, d)[1].withColumn("namespace", F.concat(F.lit("l"), F.col("label"))), 500, 768, "l3", "cosine")


@query(f"""WITH {_TOP}, c AS (SELECT query_id, list(doc_id ORDER BY rank) FILTER (rank <= 5) AS a FROM top GROUP BY 1), f AS (SELECT query_id, count(*) AS n, list(doc_id ORDER BY rank) FILTER (rank <= 5) AS b FROM ftop WHERE rank <= 8 GROUP BY 1)
    SELECT query_id, n < 8 AS fallback, n >= 8 AS filtered_success, a = b AS order_preserved FROM c JOIN f USING (query_id)""")
def case_trace(s, d):
    q, c = _vectors(s, d)
    first = lambda df: df.groupBy("query_id").agg(F.count("*").alias("n"), F.slice(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda r: r["doc_id"]), 1, 5).alias("ids"))
    f, u = first(R.vector_topk(q, c, same="label")).alias("f"), first(R.vector_topk(q, c)).alias("u")
    return f.join(u, F.col("f.query_id") == F.col("u.query_id")).select("f.query_id", (F.col("f.n") < 8).alias("fallback"), (F.col("f.n") >= 8).alias("filtered_success"), F.col("f.ids").eqNullSafe(F.col("u.ids")).alias("order_preserved"))


# ---- novelty: documents against benchmark passages


def _sides(s, d):
    return read(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), read(s, d, "benchmark").select(F.col("item_id").alias("id"), "text")


_TOK = "regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[\\p{L}\\p{N}]+')"
_SIM = f"""ct AS (SELECT doc_id AS id, {_TOK} AS w FROM documents), rt AS (SELECT item_id AS id, {_TOK} AS w FROM benchmark),
cs AS (SELECT DISTINCT id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM ct)), rs AS (SELECT DISTINCT id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM rt)),
cn AS (SELECT id, count(*) AS n FROM cs GROUP BY 1), rn AS (SELECT id, count(*) AS n FROM rs GROUP BY 1),
cont AS (SELECT cs.id AS candidate_id, rs.id AS reference_id, count(*) AS shared, round(count(*) / least(any_value(cn.n), any_value(rn.n)), 9) AS containment FROM cs JOIN rs USING (s) JOIN cn ON cn.id = cs.id JOIN rn ON rn.id = rs.id GROUP BY 1, 2),
cj AS (SELECT id, list_distinct(w) AS w FROM ct WHERE len(w) > 0), rj AS (SELECT id, list_distinct(w) AS w FROM rt WHERE len(w) > 0),
jac AS (SELECT cj.id AS candidate_id, rj.id AS reference_id, round(len(list_intersect(cj.w, rj.w)) / (len(cj.w) + len(rj.w) - len(list_intersect(cj.w, rj.w))), 9) AS jaccard FROM cj, rj WHERE len(cj.w) >= 0.6 * len(rj.w) - 1e-9 AND len(rj.w) >= 0.6 * len(cj.w) - 1e-9),
ex AS (SELECT ct.id AS candidate_id, rt.id AS reference_id, true AS exact FROM ct JOIN rt ON ct.w = rt.w AND len(ct.w) > 0),
nov AS (SELECT candidate_id, reference_id, coalesce(exact, false) AS exact, coalesce(jaccard, 0)::DOUBLE AS jaccard, coalesce(containment, 0)::DOUBLE AS containment, greatest(CASE WHEN exact THEN 1.0 ELSE 0.0 END, coalesce(jaccard, 0), coalesce(containment, 0))::DOUBLE AS overall
  FROM (SELECT * FROM cont WHERE containment >= 0.6) FULL JOIN (SELECT * FROM jac WHERE jaccard >= 0.6) USING (candidate_id, reference_id) FULL JOIN ex USING (candidate_id, reference_id))"""


@query(f"WITH t AS (SELECT doc_id, array_to_string({_TOK}, ' ') AS said FROM documents), f AS (SELECT said, min(doc_id) AS first FROM t WHERE said <> '' GROUP BY 1) SELECT doc_id AS candidate_id, first AS reference_id FROM t JOIN f USING (said) WHERE doc_id <> first")
def exact_match(s, d):
    """Documents against the first document of each text: copies are linked to one row and not to each other."""
    rows = N.normalised(_sides(s, d)[0])
    # what no other text has the hash of has no copy, so only the others' texts meet
    several = rows.join(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "h", "left_semi")
    first = several.groupBy("h", "said").agg(F.min("id").alias("id")).select("id", "said")
    return N.exact_match(several, first).where("candidate_id <> reference_id")


@query(f"WITH {_SIM} SELECT candidate_id, reference_id, containment, shared FROM cont WHERE containment >= 0.6")
def shingle_containment(s, d):
    return N.containment_join(*_sides(s, d))


@query(f"""WITH t AS (SELECT doc_id AS id, {_TOK} AS w FROM documents), u AS (SELECT id, list_distinct(w) AS w FROM t WHERE len(w) > 0),
    e AS (SELECT id, len(w) AS n, unnest(w) AS x FROM u),
    p AS (SELECT a.id AS candidate_id, b.id AS reference_id, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS j FROM e a JOIN e b ON a.x = b.x AND a.n >= 0.6 * b.n - 1e-9 AND b.n >= 0.6 * a.n - 1e-9 GROUP BY 1, 2)
    SELECT candidate_id, reference_id, round(j, 9) AS jaccard FROM p WHERE j >= 0.6 AND candidate_id < reference_id""")
def token_jaccard(s, d):
    docs, _ = _sides(s, d)
    return N.jaccard_join(docs, None)


@query(f"WITH {_SIM} SELECT * FROM nov")
def novelty_join(s, d):
    return N.novelty_join(*_sides(s, d))


_ASKED = "SELECT doc_id AS candidate_id, documents.text AS candidate, item_id AS reference_id, benchmark.text AS reference FROM documents JOIN benchmark ON doc_id % 20 = item_id % 20"


def _asked(s, d):
    """Documents and the passages retrieved for their requests: two of forty for each of twenty requests."""
    c, r = _sides(s, d)
    return N.candidate_reference_pairs(c.withColumn("request_id", F.col("id") % 20), r.withColumn("request_id", F.col("id") % 20))


@query(f"SELECT candidate_id, reference_id, candidate, reference FROM ({_ASKED})")
def candidate_reference_pairs(s, d):
    return _asked(s, d)


@query(f"""WITH a AS (SELECT p.*, d.text AS solution FROM ({_ASKED}) p LEFT JOIN documents d ON d.doc_id = p.candidate_id + 1),
    t AS (SELECT candidate_id, reference_id, {_TOK.replace('text', 'candidate')} AS x, {_TOK.replace('text', 'reference')} AS y, {_TOK.replace('text', 'solution')} AS z FROM a),
    g AS (SELECT *, list_distinct(list_transform(range(1, len(x) - 3), lambda i: array_to_string(x[i:i+4], ' '))) AS gx, list_distinct(list_transform(range(1, len(y) - 3), lambda i: array_to_string(y[i:i+4], ' '))) AS gy,
      list_distinct(list_transform(range(1, len(z) - 3), lambda i: array_to_string(z[i:i+4], ' '))) AS gz, list_intersect(list_distinct(x), list_distinct(y)) AS c, array_to_string(y, ' ') AS said, array_to_string(x[1:2], ' ') AS i, coalesce(x[3], '') AS o FROM t),
    m AS (SELECT *, len(list_distinct(x)) + len(list_distinct(y)) - len(c) AS u, least(len(gx), len(gy)) AS l, least(len(gz), len(gy)) AS lz FROM g),
    r AS (SELECT candidate_id, reference_id, x = y AND len(x) > 0 AS exact, CASE WHEN u > 0 THEN round(len(c) / u, 9) ELSE 0 END::DOUBLE AS jaccard, CASE WHEN l > 0 THEN round(len(list_intersect(gx, gy)) / l, 9) ELSE 0 END::DOUBLE AS containment,
      CASE WHEN lz > 0 THEN round(len(list_intersect(gz, gy)) / lz, 9) ELSE 0 END::DOUBLE AS solution_containment, array_to_string(list_sort(list_filter(c, lambda t: regexp_full_match(t, '[0-9]+'))), ',') AS constants,
      (length(i) >= 4 AND o <> '' AND contains(said, i) AND contains(said, o))::INTEGER AS n_copied_tests FROM m)
    SELECT *, greatest(jaccard, containment, solution_containment) AS overall, exact OR jaccard >= 0.6 OR containment >= 0.6 AS suspicious FROM r""")
def pair_similarity(s, d):
    """The next document stands for the solution; the first two words and the third for a test case."""
    after = read(s, d, "documents").select((F.col("doc_id") - 1).alias("candidate_id"), F.col("text").alias("solution"))
    w = F.col("w")
    threads = int(s.conf.get("spark.sql.shuffle.partitions"))
    case = F.struct(F.array_join(F.slice(w, 1, 2), " ").alias("input"), F.coalesce(F.get(w, F.lit(2)), F.lit("")).alias("output"))
    tests = read(s, d, "documents").select(F.col("doc_id").alias("candidate_id"), "text").repartition(threads, "candidate_id").select("candidate_id", T.tokens(F.col("text")).alias("w")).select("candidate_id", F.array(case).alias("test_cases"))
    c, r = (df.withColumn("request_id", F.col("id") % 20) for df in _sides(s, d))
    given = c.select("request_id", F.col("id").alias("candidate_id"), F.col("text").alias("candidate")).join(after, "candidate_id", "left").join(tests, "candidate_id")
    return N.pairs_by_request(given, r.select("request_id", F.col("id").alias("reference_id"), F.col("text").alias("reference")))


@query(f"WITH {_SIM} SELECT candidate_id, reference_id, overall FROM nov QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY overall DESC, reference_id) = 1")
def highest_similarity(s, d):
    return N.highest_similarity(N.novelty_join(*_sides(s, d)))


@query(f"WITH {_SIM} SELECT c.id AS candidate_id, n.o IS NOT NULL AS rejected, coalesce(n.o, '') AS offenders FROM ct c LEFT JOIN (SELECT candidate_id, string_agg(reference_id::VARCHAR, ',' ORDER BY reference_id) AS o FROM nov GROUP BY 1) n ON n.candidate_id = c.id")
def novelty_guard(s, d):
    c, r = _sides(s, d)
    return N.novelty_guard(c, N.novelty_join(c, r))


@query()
def minhash_candidates(s, d):
    return N.minhash_candidates(_sides(s, d)[0])


@query(f"WITH t AS (SELECT doc_id, {_TOK} AS w FROM documents) SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(w, lambda x: regexp_matches(x, '^[0-9]+$')))), ',') AS constants FROM t")
def constants(s, d):
    return read(s, d, "documents").select("doc_id", F.array_join(T.constants(F.col("text")), ",").alias("constants"))


@query(f"WITH t AS (SELECT doc_id, {_TOK} AS w FROM documents) SELECT doc_id, array_to_string(w, ' ') AS said FROM t")
def normalize_for_similarity(s, d):
    return read(s, d, "documents").select("doc_id", T.normalize_for_similarity(F.col("text")).alias("said"))


@query(f"WITH t AS (SELECT doc_id, {_TOK} AS w FROM documents) SELECT doc_id, len(w)::INTEGER AS n_tokens, len(list_distinct(w))::INTEGER AS n_distinct FROM t")
def token_set(s, d):
    t = T.tokens(F.col("text"))
    return read(s, d, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


@query(f"SELECT doc_id, unnest(range(len(w)))::INTEGER AS pos, unnest(w) AS token FROM (SELECT doc_id, {_TOK} AS w FROM documents)")
def tokens(s, d):
    return read(s, d, "documents").select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "token"))


@query(f"WITH {_SIM} SELECT id, count(*) AS n_shingles FROM cs GROUP BY 1")
def shingles(s, d):
    return N.shingles(_sides(s, d)[0]).groupBy("id").agg(F.count("*").alias("n_shingles"))


# ---- text and corpus rules

# Accented letters of the given texts and their plain forms, one for one.
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿășțşţÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝĂȘȚŞŢ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaststAAAAAACEEEEIIIINOOOOOUUUUYASTST"
_FOLD = f"lower(regexp_replace(translate(text, '{_ACCENTED}', '{_PLAIN}'), '[^\\x00-\\x7F]', '', 'g'))"


@query(f"SELECT doc_id, {_FOLD} AS folded FROM documents")
def fold_text(s, d):
    return read(s, d, "documents").select("doc_id", T.fold_text(F.col("text")).alias("folded"))


_TOPIC = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(f, '{'|'.join(p)}') THEN '{n}' END" for n, p in C.STOPWORD_TOPICS.items()) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT doc_id, CASE WHEN len(l) = 1 THEN l[1] ELSE 'unclassified' END AS topic FROM (SELECT doc_id, {_TOPIC} AS l FROM (SELECT doc_id, {_FOLD} AS f FROM documents))")
def classify_topic(s, d):
    return read(s, d, "documents").select("doc_id", C.classify_topic(F.col("text"), C.STOPWORD_TOPICS).alias("topic"))


@query(f"""SELECT doc_id, CASE WHEN len(regexp_extract_all(f, '\\b[a-d]\\.')) >= 3 THEN 'multiple_choice' WHEN contains(f, 'pseudocod') AND regexp_matches(f, '\\b[ab]\\)') THEN 'pseudocode_analysis'
    WHEN contains(f, 'definitia completa a subprogramului') THEN 'subprogram_implementation' WHEN regexp_matches(f, 'scrie(ti)? programul') THEN 'program_implementation' ELSE 'open_response' END AS kind FROM (SELECT doc_id, {_FOLD} AS f FROM documents)""")
def classify_type(s, d):
    return read(s, d, "documents").select("doc_id", C.classify_type(F.col("text")).alias("kind"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents),
    w AS (SELECT doc_id, list_transform(regexp_extract_all(l, '\\p{L}+'), lambda x: CASE WHEN length(x) = 1 THEN 's' ELSE 'l' END) AS w FROM l WHERE regexp_full_match(l, '[ \\t\\n\\x0b\\f\\r]*\\p{L}+([ \\t\\n\\x0b\\f\\r]+\\p{L}+)*:?[ \\t\\n\\x0b\\f\\r]*')),
    b AS (SELECT DISTINCT doc_id FROM w WHERE len(w) >= 8 AND len(list_filter(w, lambda x: x = 's')) >= 5 AND len(regexp_extract_all(array_to_string(w, ''), 's+')) >= 3)
    SELECT doc_id, CASE WHEN text IS NOT NULL THEN b.doc_id IS NOT NULL END AS fragmented FROM documents LEFT JOIN b USING (doc_id)""")
def fragmented_line(s, d):
    return read(s, d, "documents").select("doc_id", T.fragmented_line(F.col("text")).alias("fragmented"))


def _pages(s, d):
    return read(s, d, "pages").select((F.col("page_id") % 50).alias("source"), F.col("page_id").alias("page_no"), C.page_text(F.col("html")).alias("text"))


_PAGE = "trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))"


@query(f"SELECT page_id AS page_no, {_PAGE} AS text FROM pages")
def page_text(s, d):
    return _pages(s, d).select("page_no", "text")


@query(f"""SELECT source, count(*) AS n_pages, coalesce(string_agg(page_no::VARCHAR, ',' ORDER BY page_no) FILTER (text = ''), '') AS blank_pages, sum(length(text))::BIGINT AS n_chars,
    CASE WHEN count(*) FILTER (text = '') > 0 THEN 'blank_page' WHEN sum(length(text)) < 20000 THEN 'too_short' END AS reject_reason FROM (SELECT page_id % 50 AS source, page_id AS page_no, {_PAGE} AS text FROM pages) GROUP BY 1""")
def extraction_gate(s, d):
    return C.extraction_gate(_pages(s, d), 20_000)


@query("SELECT text AS id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def unique_ids_check(s, d):
    return C.unique_ids_check(read(s, d, "documents").select(F.col("text").alias("id")))


@query("""WITH a AS (SELECT year(o_orderdate) AS y, o_orderpriority AS p, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS s, o_custkey % 30 AS v, o_orderkey AS source, o_orderkey % 2 AS side FROM orders)
    SELECT CASE WHEN side = 0 THEN 'subject' ELSE 'guide' END AS side, source FROM a x WHERE NOT EXISTS (SELECT 1 FROM a y WHERE y.side <> x.side AND y.y IS NOT DISTINCT FROM x.y AND y.p IS NOT DISTINCT FROM x.p AND y.s IS NOT DISTINCT FROM x.s AND y.v IS NOT DISTINCT FROM x.v)""")
def pairing_audit(s, d):
    o = read(s, d, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("profile"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("session"), (F.col("o_custkey") % 30).alias("variant"), F.col("o_orderkey").alias("source"), (F.col("o_orderkey") % 2).alias("side"))
    return C.pairing_audit(o.where("side = 0"), o.where("side = 1"))


# ---- submissions: orders as submissions, line items as test results

_SUBS = "subs AS (SELECT o_orderkey AS id, o_custkey % 50 AS exercise_id, o_custkey AS user_id, (floor(o_totalprice)::BIGINT % 101)::INTEGER AS score, o_orderdate AS created_at FROM orders)"


def _submissions(s, d):
    return read(s, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("exercise_id"), F.col("o_custkey").alias("user_id"), (F.floor("o_totalprice").cast("long") % 101).cast("int").alias("score"), F.col("o_orderdate").alias("created_at"))


_PROG = f"""{_SUBS}, e AS (SELECT c_custkey % 50 AS exercise_id, c_custkey AS user_id FROM customer), g AS (SELECT exercise_id, user_id, count(*) AS n, max(score) AS best, arg_max(score, (created_at, id)) AS latest FROM subs GROUP BY 1, 2)"""


def _owned(s, d):
    return read(s, d, "customer").select((F.col("c_custkey") % 50).alias("exercise_id"), F.col("c_custkey").alias("user_id"))


@query(f"WITH {_PROG} SELECT exercise_id, user_id, coalesce(n, 0) AS n_submissions, best AS best_score, latest AS latest_score, coalesce(best = 100, false) AS completed FROM e LEFT JOIN g USING (exercise_id, user_id)")
def progress_by_exercise(s, d):
    return P.progress_by_exercise(_owned(s, d), _submissions(s, d))


@query(f"WITH {_PROG} SELECT exercise_id, user_id, n IS NOT NULL AS has_submitted, coalesce(n, 0) AS n_submissions, latest AS latest_score, coalesce(best = 100, false) AS completed FROM e LEFT JOIN g USING (exercise_id, user_id)")
def join_progress(s, d):
    own, sub = _owned(s, d), _submissions(s, d)
    return P.join_progress(own, P.progress_by_exercise(sub.select("exercise_id", "user_id").distinct(), sub))


@query(f"WITH {_SUBS} SELECT * FROM subs QUALIFY row_number() OVER (PARTITION BY exercise_id, user_id ORDER BY created_at DESC, id DESC) = 1")
def latest_submission(s, d):
    return P.latest_submission(_submissions(s, d))


@query(f"WITH {_SUBS} SELECT *, row_number() OVER (PARTITION BY exercise_id, user_id ORDER BY created_at DESC, id DESC)::INTEGER AS place FROM subs")
def list_submissions(s, d):
    return P.list_submissions(_submissions(s, d))


@query(f"""WITH s AS (SELECT o_orderkey AS submission_id, CASE WHEN o_orderkey % 29 = 0 THEN '{P.EMPTY}' WHEN o_orderkey % 31 = 0 THEN 'error ' || o_orderkey WHEN o_orderkey % 37 = 1 THEN '{P.NOT_COMPILED}' END AS broken FROM orders),
    g AS (SELECT l_orderkey AS submission_id, count(*) FILTER (l_linestatus = 'F') AS ok, count(*) AS n, arg_max('line ' || l_linenumber, l_linenumber) FILTER (l_returnflag = 'R') AS err FROM lineitem WHERE l_orderkey % 23 <> 0 GROUP BY 1),
    m AS (SELECT submission_id, broken, err, CASE WHEN broken IS NULL THEN coalesce(ok, 0) ELSE 0 END AS n_passed, coalesce(n, 0) AS n_total FROM s LEFT JOIN g USING (submission_id)),
    st AS (SELECT *, CASE WHEN broken IS NOT NULL THEN 'compilation_error' WHEN n_total = 0 THEN 'failed' WHEN err IS NOT NULL AND n_passed = 0 THEN 'runtime_error' WHEN n_passed = n_total THEN 'passed' WHEN n_passed = 0 THEN 'failed' ELSE 'partial' END AS status FROM m)
    SELECT submission_id, CASE WHEN n_total = 0 THEN 0 ELSE round_even(100.0 * n_passed / n_total, 0) END::INTEGER AS score, n_passed, n_total, status,
      coalesce(broken, CASE WHEN n_total = 0 THEN '{P.NO_TESTS}' WHEN status = 'runtime_error' THEN err END) AS feedback FROM st""")
def score_submission(s, d):
    li = read(s, d, "lineitem").where("l_orderkey % 23 <> 0").select(F.col("l_orderkey").alias("submission_id"), F.col("l_linenumber").alias("test_no"), (F.col("l_linestatus") == "F").alias("passed"), F.when(F.col("l_returnflag") == "R", F.concat(F.lit("line "), F.col("l_linenumber"))).alias("error"))
    k = F.col("o_orderkey")
    subs = read(s, d, "orders").select(k.alias("submission_id"), F.when(k % 29 == 0, " \n").otherwise("int main() {}").alias("code"), F.when(k % 31 == 0, F.concat(F.lit("error "), k)).when(k % 37 == 1, "").alias("compile_error"))
    return P.score_submission(li, subs)


@query(f"""WITH {_SUBS}, e AS (SELECT DISTINCT exercise_id, user_id AS owner FROM subs WHERE score > 50), t AS (SELECT DISTINCT exercise_id, user_id FROM subs WHERE score > 80), a AS (SELECT exercise_id, owner, owner - owner % 3 AS asker FROM e)
    SELECT a.exercise_id, asker, CASE WHEN asker <> owner THEN 'not_found' WHEN t.user_id IS NULL THEN 'locked' ELSE 'ok' END AS state FROM a LEFT JOIN t ON t.exercise_id = a.exercise_id AND t.user_id = asker""")
def unlock_solution(s, d):
    sub = _submissions(s, d)
    own = sub.where("score > 50").select("exercise_id", F.col("user_id").alias("owner")).distinct()
    return P.unlock_solution(own, sub.where("score > 80"), F.col("owner") - F.col("owner") % 3)


@query("SELECT conv_id AS id, coalesce(string_agg(role || ':' || text, chr(10) ORDER BY turn, role, text) FILTER (turn % 2 = 0), '') AS shown FROM conversations GROUP BY 1")
def safe_projection(s, d):
    case = F.struct(F.col("turn"), F.col("role").alias("input"), F.col("text").alias("expected_output"), (F.col("turn") % 2 != 0).alias("is_hidden"))
    made = read(s, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(case)).alias("test_cases"))
    told = lambda t: F.concat(t["input"], F.lit(":"), t["expected_output"])
    return P.safe_projection(made).select("id", F.array_join(F.transform("test_cases", told), "\n").alias("shown"))


@query("""WITH c AS (SELECT conv_id AS request_id, turn AS attempt, CASE WHEN length(text) % 3 <> 0 THEN 'e' || turn END AS error FROM conversations WHERE turn <= 6),
    g AS (SELECT request_id, min(attempt) FILTER (error IS NULL) AS attempt, arg_max(error, attempt) FILTER (error IS NOT NULL) AS last FROM c GROUP BY 1) SELECT request_id, attempt, CASE WHEN attempt IS NULL THEN last END AS error FROM g""")
def first_valid_attempt(s, d):
    c = read(s, d, "conversations")
    return C.first_valid_attempt(c.select(F.col("conv_id").alias("request_id"), F.col("turn").alias("attempt"), F.when(F.length("text") % 3 != 0, F.concat(F.lit("e"), F.col("turn"))).alias("error")))


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(lower(p_name), 'a') AND p_size % 2 = 0")
def filter_topic_difficulty(s, d):
    p = read(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("topic"), F.when(F.col("p_size") % 2 == 0, "easy").otherwise("hard").alias("difficulty"))
    return P.filter_topic_difficulty(p, " A ", "easy").select("id", F.col("topic").alias("name"))


@query(f"WITH {_SUBS} SELECT * FROM subs WHERE user_id = 7")
def filter_owner(s, d):
    return P.filter_owner(_submissions(s, d), 7)


@query(f"WITH {_SUBS} SELECT * FROM subs WHERE exercise_id IN (SELECT s_suppkey FROM supplier)")
def submission_owner(s, d):
    return _submissions(s, d).join(read(s, d, "supplier").select(F.col("s_suppkey").alias("exercise_id")), "exercise_id", "left_semi")


# ---- rate limits and streams


def _requests(s, d):
    return read(s, d, "events").select(F.col("user_id").cast("string").alias("key"), "ts", "event_id")


_DAY = 86_400_000_000
_ARRIVALS = "e AS (SELECT user_id::VARCHAR AS key, epoch_us(ts) AS t, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"


@query(f"""WITH RECURSIVE {_ARRIVALS},
    s AS (SELECT key, event_id, i, true AS allowed, NULL::BIGINT AS before, t AS last FROM e WHERE i = 1
      UNION ALL SELECT key, event_id, i, ok, CASE WHEN ok THEN last ELSE before END, CASE WHEN ok THEN t ELSE last END
      FROM (SELECT e.*, before, last, before IS NULL OR e.t >= before + {_DAY} AS ok FROM s JOIN e ON e.key = s.key AND e.i = s.i + 1))
    SELECT key, event_id, allowed FROM s""")
def rate_limit_sliding(s, d):
    return L.rate_limit_sliding(_requests(s, d), 2, 86_400)


@query(f"""WITH RECURSIVE {_ARRIVALS},
    s AS (SELECT key, event_id, i, t AS start, 1 AS n FROM e WHERE i = 1
      UNION ALL SELECT e.key, e.event_id, e.i, CASE WHEN e.t >= start + {_DAY} THEN e.t ELSE start END, CASE WHEN e.t >= start + {_DAY} THEN 1 ELSE n + 1 END FROM s JOIN e ON e.key = s.key AND e.i = s.i + 1)
    SELECT key, event_id, n <= 2 AS allowed FROM s""")
def rate_limit_fixed(s, d):
    return L.rate_limit_fixed(_requests(s, d), 2, 86_400)


#: Rules of the query: action, limit, window in seconds. Other actions are free.
_RULES = [("click", 1, 86_400), ("view", 2, 172_800), ("purchase", 3, 604_800)]


@query(f"""WITH RECURSIVE rules(action, most, span) AS (VALUES {', '.join(f"('{a}', {n}, {w}000000)" for a, n, w in _RULES)}),
    e AS (SELECT event_type || ':' || user_id AS key, epoch_us(ts) AS t, event_id, most, span, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS i FROM events LEFT JOIN rules ON action = event_type),
    s AS (SELECT key, event_id, i, true AS allowed, [t] AS log FROM e WHERE i = 1
      UNION ALL SELECT key, event_id, i, ok, CASE WHEN ok THEN list_append(live, t) ELSE live END
      FROM (SELECT *, most IS NULL OR len(live) < most AS ok FROM (SELECT e.*, CASE WHEN most IS NULL THEN [] ELSE list_filter(s.log, lambda x: x > e.t - span) END AS live FROM s JOIN e ON e.key = s.key AND e.i = s.i + 1)))
    SELECT key, event_id, allowed FROM s""")
def rate_limit_keys(s, d):
    e = read(s, d, "events").select(F.col("event_type").alias("action"), F.col("user_id").alias("user"), "ts", "event_id")
    return L.rate_limit_keys(e, s.createDataFrame(_RULES, "action string, limit int, window_s int"))


def _stream(s, d, name):
    return s.readStream.schema(read(s, d, name).schema).parquet(f"{d}/{name}.parque[t]")  # a pattern, since a stream takes no single file


@query(f"WITH {_SUBS} SELECT exercise_id, user_id, count(*) AS n, max(score) AS best_score FROM subs GROUP BY 1, 2")
def stream_progress(s, d):
    o = _stream(s, d, "orders")
    return streams.stream_progress(s, o.select((F.col("o_custkey") % 50).alias("exercise_id"), F.col("o_custkey").alias("user_id"), (F.floor("o_totalprice").cast("long") % 101).cast("int").alias("score")))


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def stream_upsert(s, d):
    return streams.stream_upsert(s, _stream(s, d, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id")


def _store(s, d, keys):
    """Events as a store by event type; users are the scope of deletes."""
    e = read(s, d, "events").select("user_id", "event_id", F.col("event_id").alias("version"), F.col("event_type").alias("namespace"), "value")
    return e, Store.create(s, io.work_dir(s, "store"), e.schema, keys, "version", namespace="namespace", scope="user_id")


@query("SELECT user_id, event_id, event_id AS version, event_type AS namespace, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) = 1")
def upsert_vectors(s, d):
    """Two batches, the second one twice, and what the store then holds."""
    e, store = _store(s, d, ["user_id"])
    for name, part in (("even", 0), ("odd", 1), ("odd", 1)):
        store.upsert(e.where(F.col("version") % 2 == part), name)
    return store.read()


@query("""WITH own AS (SELECT count(*) AS n FROM events WHERE user_id = 7), kept AS (SELECT * FROM events WHERE user_id IS DISTINCT FROM 7)
    SELECT event_type AS namespace, count(*) AS n_left, count(DISTINCT user_id) AS n_users, sum(event_id)::BIGINT AS id_sum, any_value(own.n) AS inserted, any_value(own.n) - count(*) FILTER (user_id = 7) AS deleted,
      count(*) FILTER (user_id = 7) AS remaining, count(*) FILTER (user_id = 7) = 0 AS completed FROM kept, own GROUP BY 1""")
def scoped_delete(s, d):
    """The table after a user's rows were deleted, by namespace, and the report of the delete."""
    e, store = _store(s, d, ["event_id"])
    store.upsert(e, "all")
    report = store.delete(7)
    told = [F.lit(report[c]).cast(kind).alias(c) for c, kind in (("inserted", "long"), ("deleted", "long"), ("remaining", "long"), ("completed", "boolean"))]
    return store.read().groupBy("namespace").agg(F.count("*").alias("n_left"), F.count_distinct("user_id").alias("n_users"), F.sum("event_id").alias("id_sum")).select("*", *told)


QUERIES |= corpus_queries.QUERIES | record_queries.QUERIES
SQL |= corpus_queries.SQL | record_queries.SQL
SQL["stream_novelty_guard"] = SQL["novelty_guard"]
