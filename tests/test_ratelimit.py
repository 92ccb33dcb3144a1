"""Rate limits against a sequential run, with keys that lie in many parts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import ratelimit as L

START = dt.datetime(2024, 1, 1)


def table(spark, rows):
    return spark.createDataFrame([(k, START + dt.timedelta(microseconds=m), e) for k, m, e in rows], "key string, ts timestamp, event_id long")


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1], r[2]))


def sliding(rows, limit, window):
    logs, out = {}, {}
    for k, m, e in in_order(rows):
        log = [t for t in logs.get(k, []) if t > m - window * 10**6]
        out[k, e] = len(log) < limit
        logs[k] = [*log, m] if out[k, e] else log
    return out


def fixed(rows, limit, window):
    state, out = {}, {}
    for k, m, e in in_order(rows):
        start, n = state.get(k, (None, 0))
        start, n = (m, 1) if start is None or m >= start + window * 10**6 else (start, n + 1)
        state[k], out[k, e] = (start, n), n <= limit
    return out


def cases():
    rng = random.Random(5)
    busy = [("hot", rng.randrange(0, 300 * 10**6), e) for e in range(600)]
    steady = [("steady", i * 10**6, 10_000 + i) for i in range(200)]
    ties = [("tie", (i // 3) * 5 * 10**6, 20_000 + i) for i in range(60)]
    few = [(f"k{i % 17}", rng.randrange(0, 500 * 10**6), 30_000 + i) for i in range(150)]
    edge = [("edge", m, 40_000 + i) for i, m in enumerate((0, 9_999_999, 10_000_000, 19_999_999, 20_000_000, 20_000_001))]
    none = [(None, i * 3 * 10**6, 50_000 + i) for i in range(30)] + [("", i * 4 * 10**6, 60_000 + i) for i in range(30)]
    rows = busy + steady + ties + few + edge + none
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [40, 100_000])
def test_limits_equal_a_sequential_run(spark, size):
    rows = cases()
    df = table(spark, rows)
    said = lambda out: {(r.key, r.event_id): r.allowed for r in out.collect()}
    assert said(L.rate_limit_fixed(df, 3, 10, size)) == fixed(rows, 3, 10)
    assert said(L.rate_limit_sliding(df, 1, 10, size)) == sliding(rows, 1, 10)
    assert said(L.rate_limit_sliding(df, 3, 10, size)) == sliding(rows, 3, 10)


def test_hot_key_lies_in_many_parts(spark):
    df = spark.range(20_000).select(F.lit("k").alias("key"), F.timestamp_micros(F.col("id") * 100_000).alias("ts"), F.col("id").alias("event_id"))
    laid, ends = L._laid(L._ruled(df, 2, 60), 1_000)
    assert len(ends) >= 15 and max(n for *_, n in ends) < 3_000
    got = {r.event_id for r in L.rate_limit_fixed(df, 2, 60, 1_000).where("allowed").collect()}
    assert got == {600 * i + j for i in range(34) for j in (0, 1) if 600 * i + j < 20_000}


def test_rules_by_action_and_odd_rows(spark):
    rows = [("gen", 1, 0, 1), ("gen", 1, 1, 2), ("gen", 2, 1, 3), ("run", 1, 1, 4), ("run", 1, 2, 5), ("run", 1, 3, 6), ("free", 1, 1, 7), ("free", 1, 1, 8), ("shut", 1, 1, 9)]
    e = spark.createDataFrame([(a, u, START + dt.timedelta(seconds=s), i) for a, u, s, i in rows], "action string, user long, ts timestamp, event_id long")
    limits = spark.createDataFrame([("gen", 1, 60), ("run", 2, 60), ("shut", 0, 60)], "action string, limit int, window_s int")
    got = {r.event_id: r.allowed for r in L.rate_limit_keys(e, limits).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: True, 6: False, 7: True, 8: True, 9: False}
    none = spark.createDataFrame([("a", None, 1)], "key string, ts timestamp, event_id long")
    for f in (L.rate_limit_fixed, L.rate_limit_sliding):
        assert f(none, 2, 10).count() == 0 and f(none.limit(0), 2, 10).count() == 0
        with pytest.raises(ValueError):
            f(none, 0, 10)
