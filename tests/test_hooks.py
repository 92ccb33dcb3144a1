"""Hooks and captured failures, the report, the gate, and order statistics."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from spindrift.operators import evaluation as E
from spindrift.operators import hooks as H


def frame(spark, n=20):
    return spark.range(n).select(F.col("id").alias("query_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit(1).alias("row"), F.lit(2).alias("value"))


def upper(texts):
    if any(t in ("t3", "t11") for t in texts):
        raise RuntimeError("bad " + texts[0])
    return [t.upper() for t in texts]


def test_a_failing_row_leaves_the_others_whole(spark):
    made = H.hooked(frame(spark).repartition(2), "text", "out", "string", upper, "text", batch=4, on_error="capture")
    assert made.columns == [*frame(spark).columns, "out", "error"]
    rows = {r.query_id: r for r in made.collect()}
    assert {i for i, r in rows.items() if r.error} == {3, 11} and all(rows[i].out == f"T{i}" for i in rows if i not in (3, 11))
    assert sorted(map(tuple, H.dead_letters(made, "query_id").collect())) == [(3, "text", "RuntimeError: bad t3"), (11, "text", "RuntimeError: bad t11")]
    assert H.fail_open(made, "out", "").where("out = ''").count() == 2
    with pytest.raises(Exception, match="bad"):
        H.hooked(frame(spark), "text", "out", "string", upper, "text").collect()


def test_counts_are_a_contract(spark):
    sizes = lambda texts: [[float(len(texts))] * 2 for _ in texts]
    got = H.hooked(frame(spark, 10).coalesce(1), "text", "vector", "array<double>", sizes, "embed", batch=4).collect()
    assert sorted(r.vector[0] for r in got) == [2.0] * 2 + [4.0] * 8
    for mode in ("raise", "capture"):
        for wrong in (lambda t: t[:-1], lambda t: None, lambda t: [*t, t[0]]):
            with pytest.raises(Exception, match=r"embed: \d results for 4 rows in partition 0, rows 0 to 3"):
                H.hooked(frame(spark, 10).coalesce(1), "text", "out", "string", wrong, "embed", batch=4, on_error=mode).collect()
    assert H.hooked(frame(spark, 0), "text", "out", "string", upper, "x").count() == 0
    with pytest.raises(ValueError):
        H.hooked(frame(spark), "text", "out", "string", upper, "x", on_error="hide")


def test_context_fails_open_or_propagates(spark):
    out, lost = H.provided_context(frame(spark, 5), upper)
    assert {r.query_id: r.context for r in out.collect()} == {0: "T0", 1: "T1", 2: "T2", 3: "", 4: "T4"} and lost.count() == 1
    with pytest.raises(Exception, match="bad"):
        H.provided_context(frame(spark, 5), upper, open_on_failure=False)[0].collect()
    off, lost = H.provided_context(frame(spark, 5), upper, enabled=False)
    assert {r.context for r in off.collect()} == {""} and lost is None


def test_order_statistics(spark):
    rng = random.Random(9)
    rows = [("a", rng.choice([1.5, 2.0, 7.25])) for _ in range(501)] + [("b", float(i)) for i in range(100)] + [("c", 4.0), (None, 3.0), (None, None), ("d", None)] + [("e", float(-i)) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, value double")

    def want(values):
        v = sorted(values)
        return (len(v), round(statistics.fmean(v), 6), statistics.median(v), v[max(0, math.ceil(0.95 * len(v)) - 1)], v[0], v[-1])

    got = {r.k: tuple(r)[1:] for r in E.latency_stats(df, "k").collect()}
    assert got == {k: want([v for x, v in rows if x == k and v is not None]) for k in ("a", "b", "c", None, "e")}
    assert tuple(E.latency_stats(df).first()) == want([v for _, v in rows if v is not None])
    assert tuple(E.latency_stats(df.limit(0)).first()) == (0, 0.0, 0.0, 0.0, 0.0, 0.0) and E.latency_stats(df.limit(0), "k").count() == 0


def test_report_without_success_and_gate(spark):
    schema = "query_id long, topic string, " + ", ".join(f"{c} double" for c in E.METRICS) + ", outcome string, " + ", ".join(f"{c} double" for c in E.LATENCIES)
    failures = spark.createDataFrame([(1, "x", "reranker"), (2, "y", "retrieval")], "query_id long, topic string, stage string")
    rows = {(r.topic, r.is_total): r for r in E.evaluation_report(spark.createDataFrame([], schema), failures).collect()}
    assert set(rows) == {("x", 0), ("y", 0), (None, 1)} and rows[None, 1].failed == 2 and rows[None, 1].failed_ratio == 1.0 and rows["x", 0].retrieval_p95 == 0.0
    case = lambda *r: spark.createDataFrame(list(r), "success boolean, fallback boolean, suspicious boolean, context_non_empty boolean, order_preserved boolean")
    good = (True, False, False, True, True)
    assert E.run_gate(case(good, good), E.CONDITIONS, 3, 3).first().release
    assert E.run_gate(case(good, (False, *good[1:])), E.CONDITIONS, 3, 3).first().against == "n_failed"
    assert E.run_gate(case(good, (True, False, None, True, None)), E.CONDITIONS | {"cleanup_completed": False}, 3, 2).first().against == "n_suspicious,n_order_lost,cleanup_completed,deleted_count"
    with pytest.raises(ValueError):
        E.run_gate(case(good), {}, 0, 0)
