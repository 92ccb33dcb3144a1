"""Rate limits of whole event tables: sliding and fixed windows by key.

A decision depends on the decisions before it, but no key is folded in one task. Events are laid out by ranges of
(key, time, id) in parts of about ``PART`` rows, so that a hot key lies in many parts; the driver holds a few numbers for each part.

**Fixed windows** by pointer doubling. Each arrival points to the first one of its key that can open the next window, a window's length or more later: found
in the one part where it must lie, which the parts' last rows tell. The arrivals that do open windows are those reached from a key's first one;
doubled pointers reach them in a logarithm of the longest chain, by joins over written tables. Rejected arrivals count, so
an arrival is allowed by its place after the one that opened its window.

**Sliding windows** of one accepted arrival are the same chain. For more, what is accepted depends on several arrivals before it, which no single pointer
holds: each part is folded with the last accepted arrivals of the part before it, all parts at once and from nothing at
first, and then only parts whose key goes on and whose start has changed, until none does. A part's start is settled by its
predecessor's, so this ends after as many rounds as a key has parts, and mostly after two, since a quiet stretch makes any start alike.
A task holds one part.

``events``: key, ts, event_id. ``limit`` and ``window_s`` are numbers, or with ``limits`` come from a table of rules. Equal times go by event_id. A null key is a key. A null ts
is no time: such arrivals are not returned. Repeated rows are arrivals each, though ids should differ to tell them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.sources.io import work_dir

#: Rows of a part.
PART = 200_000


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _laid(events: DataFrame, size: int) -> tuple[DataFrame, list]:
    """part, key (null told by ``none``), at, event_id, limit and span (microseconds), and of each part its number, first and last (none, key, at), and rows, in order."""
    timed = events.where("ts is not null").select(F.col("key").isNull().alias("none"), F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").cast("long").alias("event_id"), F.col("limit").cast("int").alias("limit"), (F.col("window_s").cast("long") * 1_000_000).alias("span"))
    parts = max(1, -(-timed.count() // size))
    ranged = timed.repartitionByRange(parts, "none", "key", "at", "event_id")
    laid = _kept(ranged.withColumn("part", F.spark_partition_id()), "arrivals")
    row = F.struct("none", "key", "at")
    ends = laid.groupBy("part").agg(F.min(row).alias("first"), F.max(row).alias("last"), F.count("*").alias("n")).orderBy("part").collect()  # one row for each part
    return laid, [(r["part"], tuple(r["first"]), tuple(r["last"]), r["n"]) for r in ends]


def _routed(laid: DataFrame, ends: list) -> DataFrame:
    """Every arrival with the time (``until``) that the next window may open at, and the part (``goes``) where the first arrival from then on must lie."""
    from bisect import bisect_left

    lasts, parts = [e[2] for e in ends], [e[0] for e in ends]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            none, key, at, event, span = (b.column(i).to_pylist() for i in range(5))
            until = [t + s for t, s in zip(at, span, strict=True)]
            found = [bisect_left(lasts, x) for x in zip(none, key, until, strict=True)]
            goes = [parts[i] if i < len(parts) else None for i in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(until, pa.int64()), pa.array(goes, pa.int32())], ["none", "key", "at", "event_id", "until", "goes"])

    return laid.select("none", "key", "at", "event_id", "span").mapInArrow(run, "none boolean, key string, at long, event_id long, until long, goes int").where("goes is not null")


def _next(there: pa.Table, asked: pa.Table) -> pa.Table:
    """For each arrival asked for, the first of its key in this part at ``until`` or later."""
    from bisect import bisect_left

    rows = sorted(zip(*(there[c].to_pylist() for c in ("none", "key", "at", "event_id")), strict=True))
    times = [r[:3] for r in rows]
    out: list[list] = [[], [], [], [], [], []]
    for none, key, at, event, until in zip(*(asked[c].to_pylist() for c in ("none", "key", "at", "event_id", "until")), strict=True):
        i = bisect_left(times, (none, key, until))
        if i < len(rows) and rows[i][:2] == (none, key):
            for c, v in zip(out, (none, key, at, event, *rows[i][2:]), strict=True):
                c.append(v)
    kinds = [pa.bool_(), pa.string(), *[pa.int64()] * 4]
    return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["none", "key", "at", "event_id", "to_at", "to_id"])


def window_starts(laid: DataFrame, ends: list) -> DataFrame:
    """none, key, at and event_id of the arrivals that open a window."""
    node, into = ["none", "key", "at", "event_id"], ["none", "key", "to_at", "to_id"]
    asked = _routed(laid, ends)
    out = "none boolean, key string, at long, event_id long, to_at long, to_id long"
    links = _kept(laid.select("part", *node).groupBy("part").cogroup(asked.groupBy("goes")).applyInArrow(_next, out), "next-windows")
    roots = laid.groupBy("none", "key").agg(F.min(F.struct("at", "event_id")).alias("m")).select("none", "key", "m.at", "m.event_id")
    reached = _kept(roots, "starts")
    # only what opens a window for some arrival can be on a chain
    ahead = links.select("none", "key", F.col("to_at").alias("at"), F.col("to_id").alias("event_id")).union(roots).distinct()
    jump = _kept(links.join(ahead, node, "left_semi").distinct(), "jumps")
    while True:
        new = jump.join(reached, node, "left_semi").select("none", "key", F.col("to_at").alias("at"), F.col("to_id").alias("event_id"))
        more = _kept(reached.union(new).distinct(), "starts")
        if more.count() == reached.count():
            return reached
        reached = more
        far = jump.select("none", "key", F.col("at").alias("to_at"), F.col("event_id").alias("to_id"), F.col("to_at").alias("then_at"), F.col("to_id").alias("then_id"))
        jump = _kept(jump.join(far, into).select(*node, F.col("then_at").alias("to_at"), F.col("then_id").alias("to_id")), "jumps")


def _rows(df: DataFrame) -> DataFrame:
    return df.select(F.when(F.col("none"), F.lit(None)).otherwise(F.col("key")).alias("key"), "event_id", "allowed")


def _chained(laid: DataFrame, ends: list, rejected_count: bool) -> DataFrame:
    """Decisions by the arrivals that open windows. ``rejected_count``: by the place in the window, else only its opener is allowed."""
    opened = window_starts(laid, ends).withColumn("opens", F.lit(True))
    marked = _kept(laid.join(opened, ["none", "key", "at", "event_id"], "left").withColumn("opens", F.coalesce("opens", F.lit(False))), "marked")
    if not rejected_count:
        return _rows(marked.withColumn("allowed", F.col("opens")))
    # each part's last opener, as its place among the part's rows: what the next part begins with
    place = F.struct("none", "key", "at", "event_id")
    last = {r["part"]: (r["m"]["none"], r["m"]["key"], r["m"]["at"], r["m"]["event_id"]) for r in marked.where("opens").groupBy("part").agg(F.max(place).alias("m")).collect()}
    after: dict[int, int] = {}
    if last:
        known = marked.sparkSession.createDataFrame([(p, *m) for p, m in last.items()], "part int, lnone boolean, lkey string, lat long, lid long")
        later = (F.col("none") == F.col("lnone")) & (F.col("key") == F.col("lkey")) & ((F.col("at") > F.col("lat")) | ((F.col("at") == F.col("lat")) & (F.col("event_id") >= F.col("lid"))))
        after = {r["part"]: r["n"] for r in marked.join(F.broadcast(known), "part").where(later).groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row for each part
    carry: dict[int, int] = {}
    held, held_key = 0, None
    for part, first, end, n in ends:
        if held_key == first[:2]:
            carry[part] = held
        if part in last:
            held, held_key = (after.get(part, 0), end[:2]) if last[part][:2] == end[:2] else (0, None)
        elif held_key == end[:2]:
            held += n

    def run(t: pa.Table) -> pa.Table:
        import numpy as np

        t = t.sort_by([(c, "ascending") for c in ("none", "key", "at", "event_id")])
        part = t["part"][0].as_py()
        opens = t["opens"].to_numpy()
        at = np.arange(len(opens))
        since = np.maximum.accumulate(np.where(opens, at, -1))
        n = np.where(since >= 0, at - since + 1, at + 1 + carry.get(part, 0))
        return pa.table([t["none"], t["key"], t["event_id"], pa.array(n <= t["limit"].to_numpy())], names=["none", "key", "event_id", "allowed"])

    return _rows(marked.groupBy("part").applyInArrow(run, "none boolean, key string, event_id long, allowed boolean"))


def _relayed(laid: DataFrame, ends: list) -> DataFrame:
    """Sliding decisions of any limit, part by part with what was accepted last in the part before."""
    schema = "part int, none boolean, key string, event_id long, allowed boolean, state array<long>"

    def folded(starts: dict[int, list[int]]):
        def run(t: pa.Table) -> pa.Table:
            from collections import deque

            t = t.sort_by([(c, "ascending") for c in ("none", "key", "at", "event_id")])
            part = t["part"][0].as_py()
            log, last, said = deque(starts.get(part, [])), None, []
            for none, key, at, limit, span in zip(*(t[c].to_pylist() for c in ("none", "key", "at", "limit", "span")), strict=True):
                if last is not None and last != (none, key):
                    log.clear()
                last = (none, key)
                while log and log[0] <= at - span:
                    log.popleft()
                said.append(len(log) < limit)
                if said[-1]:
                    log.append(at)
            n = len(said)
            states = [None] * (n - 1) + [list(log)]
            return pa.table([t["part"], t["none"], t["key"], t["event_id"], pa.array(said), pa.array(states, pa.list_(pa.int64()))], names=["part", "none", "key", "event_id", "allowed", "state"])

        return run

    starts: dict[int, list[int]] = {}
    done = _kept(laid.groupBy("part").applyInArrow(folded({}), schema), "decided")
    final, left = {r["part"]: list(r["state"]) for r in done.where("state is not null").select("part", "state").collect()}, {p for p, *_ in ends}
    tables = {p: done for p in left}
    while True:
        changed = {}
        for before, here in zip(ends, ends[1:], strict=False):
            want = final[before[0]] if before[2][:2] == here[1][:2] else []
            if want != starts.get(here[0], []):
                changed[here[0]] = want
        if not changed:
            break
        starts |= changed
        again = _kept(laid.where(F.col("part").isin(list(changed))).groupBy("part").applyInArrow(folded(dict(changed)), schema), "decided")
        final |= {r["part"]: list(r["state"]) for r in again.where("state is not null").select("part", "state").collect()}
        tables |= dict.fromkeys(changed, again)
    whole = None
    for t in {id(x): x for x in tables.values()}.values():
        own = t.where(F.col("part").isin([p for p, x in tables.items() if x is t]))
        whole = own if whole is None else whole.union(own)
    return _rows(whole) if whole is not None else _rows(done)


def _ruled(events: DataFrame, limit: int, window_s: int) -> DataFrame:
    if limit < 1 or window_s < 1:
        raise ValueError("limit and window must be positive")
    return events.select("key", "ts", "event_id", F.lit(limit).alias("limit"), F.lit(window_s).alias("window_s"))


def rate_limit_sliding(events: DataFrame, limit: int, window_s: int, size: int = PART) -> DataFrame:
    """key, event_id and ``allowed``: fewer than ``limit`` accepted in (ts - window, ts]."""
    laid, ends = _laid(_ruled(events, limit, window_s), size)
    return _chained(laid, ends, False) if limit == 1 else _relayed(laid, ends)


def rate_limit_fixed(events: DataFrame, limit: int, window_s: int, size: int = PART) -> DataFrame:
    """The same with a counter that starts at a key's first arrival and expires after the window; rejected arrivals count."""
    return _chained(*_laid(_ruled(events, limit, window_s), size), True)


def rate_limit_keys(events: DataFrame, limits: DataFrame, size: int = PART) -> DataFrame:
    """Sliding limits by action: ``events`` (action, user, ts, event_id) under ``limits`` (action, limit, window_s; one row for each action).

    A key is an action and a user. Actions without a rule are always allowed. A limit of zero or less lets nothing pass."""
    met = events.join(limits.select("action", "limit", "window_s"), "action", "left")
    key = F.concat(F.col("action"), F.lit(":"), F.col("user").cast("string"))
    ruled = met.where("limit is not null").select(key.alias("key"), "ts", "event_id", "limit", "window_s")
    free = met.where("limit is null and ts is not null").select(key.alias("key"), F.col("event_id").cast("long").alias("event_id"), F.lit(True).alias("allowed"))
    return _relayed(*_laid(ruled, size)).union(free)
