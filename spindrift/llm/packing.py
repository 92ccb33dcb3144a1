"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of packets: its documents' tokens, cut every ``length`` tokens. A window is a round of the
round-robin: each source is credited ``per_round`` tokens times its target proportion and serves packets as long as its
deficit covers the next one whole; what is left of the deficit is carried to the next round, and an empty queue is
passed over. Windows follow each other in one stream that is cut into sequences of ``length`` tokens, so
that only the last sequence needs padding. A source is never more than a packet away from its proportion,
and documents stay whole but for packets and the cuts between sequences.

A queue's credit after k rounds is k times its credit a round, so a packet that ends ``end`` tokens into its queue is served
in round ceil(end / credit) - 1, without playing the rounds before: deficits are carried across windows and
partitions by arithmetic, and windows are laid out in parallel. Queue positions are running sums in two levels (inside small
hashed parts of a source, then over the parts) and window positions in three, so that a hot source is spread like any
other and no task sums more than a bounded share. Lengths alone pass through this layout; ids are written once, and meet
their places in one join.

Without given proportions the targets are the sources' token shares to the power ``flatten``, scaled to one: at 1 every window is a
sample of the corpus, below 1 small sources come in faster than they would by size and end sooner. A source that the given
proportions leave out is credited its own share of the corpus: nothing is dropped.
A null text is empty (its only id is the end id), a null source is the source ''. Repeated rows and ids
are packed as often as they occur; other columns are not read. An empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.llm.common import encoder, packed, partitions, table, written

LENGTH = 1024
#: Tokens of a window.
ROUND = 64 * LENGTH
END = 0
#: Power of the query's target proportions.
FLATTEN = 0.7
#: Rounds whose positions are summed together, as a power of two.
BLOCK = 12


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenized(docs: DataFrame, path: str, end: int) -> DataFrame:
    """doc_id, source, ids (packed 16-bit, with the end id) and n of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, True)
        for b in batches:
            at = 0
            for every, n in enc.encode(b.column(2), end):
                part = b.slice(at, len(n))
                at += len(n)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), packed(every, n), pa.array(n, pa.int64())], ["doc_id", "source", "ids", "n"])

    read = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source"), F.lit("")).alias("source"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return read.mapInArrow(run, "doc_id long, source string, ids binary, n long")


def queues(rows: DataFrame, pieces: int) -> DataFrame:
    """``rows`` (row, source, n) with ``piece`` (of its source) and ``at``: the tokens before it in its source's queue."""
    dealt = rows.withColumn("piece", F.pmod(F.xxhash64("row"), F.lit(pieces)))
    inside = dealt.withColumn("at", F.sum("n").over(Window.partitionBy("source", "piece").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    sums = dealt.groupBy("source", "piece").agg(F.sum("n").alias("m"))
    before = sums.select("source", "piece", (F.sum("m").over(Window.partitionBy("source").orderBy("piece")) - F.col("m")).alias("before"))
    return inside.join(before.hint("merge"), ["source", "piece"]).select("row", "source", "piece", "n", (F.col("at") + F.col("before")).alias("at"))


def credited(rows: DataFrame, proportions: dict[str, float] | None, per_round: int, flatten: float) -> DataFrame:
    """source and its credit a round; ``rows``: source, n."""
    totals = written(rows.groupBy("source").agg(F.sum("n").alias("total")), "source-totals")
    own = F.pow(F.col("total"), F.lit(1.0 if proportions else flatten))
    whole = totals.agg(F.sum(own)).collect()[0][0] or 1.0
    share = own / F.lit(float(whole))
    if proportions:
        given = totals.sparkSession.createDataFrame(list(proportions.items()), "source string, given double")
        totals = totals.join(F.broadcast(given), "source", "left")  # a parameter
        share = F.when(F.col("given") > 0, F.col("given")).otherwise(share)
    return totals.select("source", (share * per_round).alias("credit"))


def placed(queued: DataFrame, length: int) -> DataFrame:
    """row, start, length and ``pos`` in the stream of every packet; ``queued``: row, source, n, at and credit."""
    packets = queued.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / length).cast("long"))))
    size = F.least(F.lit(length), F.col("n") - F.col("j") * length)
    laid = packets.select("row", "source", (F.col("j") * length).alias("start"), size.alias("length"), (F.col("at") + F.col("j") * length).alias("at"), "credit")
    laid = written(laid.select("row", "source", "start", "length", "at", (F.ceil((F.col("at") + F.col("length")) / F.col("credit")) - 1).cast("long").alias("k")), "packets")
    # a source's packets of one round follow each other; rounds are summed by blocks, and those by larger ones
    turns = laid.groupBy("k", "source").agg(F.sum("length").alias("m"), F.min("at").alias("first"))
    low, high = F.shiftright("k", BLOCK).alias("low"), F.shiftright("k", 2 * BLOCK).alias("high")
    turns = written(turns.select("k", "source", "m", "first", low, high), "turns")
    upto = lambda name, *order: F.sum("m").over(Window.partitionBy(name).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")
    lows = turns.groupBy("low", "high").agg(F.sum("m").alias("m"))
    highs = lows.groupBy("high").agg(F.sum("m").alias("m"))  # a row for each 16,777,216 rounds
    top = highs.withColumn("all", F.lit(0)).select("high", upto("all", "high").alias("c"))
    mid = lows.select("low", "high", upto("high", "low").alias("b")).join(top.hint("merge"), "high").select("low", (F.col("b") + F.col("c")).alias("b"))
    base = turns.select("k", "source", "first", "low", upto("low", "k", "source").alias("a")).join(mid.hint("merge"), "low").select("k", "source", "first", (F.col("a") + F.col("b")).alias("base"))
    return laid.join(base.hint("merge"), ["k", "source"]).select("row", "start", "length", (F.col("base") + F.col("at") - F.col("first")).alias("pos"))


def pack(docs: DataFrame, proportions: dict[str, float] | None = None, length: int = LENGTH, per_round: int = ROUND, path: str | None = None, end: int = END, flatten: float = 1.0) -> DataFrame:
    """Pieces: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    held = written(tokenized(docs, path or tokenizer_path(), end).withColumn("row", F.monotonically_increasing_id()), "tokens")
    pieces = partitions(spark)
    rows = written(queues(held.select("row", "source", "n"), pieces), "queues")
    # a credit for each piece of a source, so that a source with most rows is joined in as many tasks
    credits = credited(rows, proportions, per_round, flatten).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pieces - 1).cast("long"))))
    spots = placed(rows.join(credits.hint("merge"), ["source", "piece"]), length)
    spans = spots.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "length", "pos"))).alias("spans"))
    met = held.select("row", "doc_id", "ids", "n").join(spans.hint("merge"), "row").select("doc_id", "ids", "n", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                spans = part.column(3)
                inner = spans.flatten()
                many = np.diff(spans.offsets.to_numpy())
                start, size, pos = (inner.field(c).to_numpy().astype(np.int64) for c in range(3))
                of = np.repeat(np.arange(part.num_rows), many)
                # packets that follow each other in both the document and the stream are one piece
                new = np.ones(len(of), bool)
                new[1:] = (of[1:] != of[:-1]) | (pos[1:] != pos[:-1] + size[:-1])
                at = np.flatnonzero(new)
                start, pos, of, size = start[at], pos[at], of[at], np.add.reduceat(size, at) if len(at) else size
                # and a piece ends where its sequence does
                cuts = (pos + size - 1) // length - pos // length + 1
                which = np.repeat(np.arange(len(at)), cuts)
                step = np.arange(len(which)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                edge = (pos[which] // length + step) * length
                lo, hi = np.maximum(edge, pos[which]), np.minimum(edge + length, pos[which] + size[which])
                begin, n, of = start[which] + lo - pos[which], hi - lo, of[which]
                ids = part.column(1)
                ends = np.frombuffer(ids.buffers()[1], "<i4", len(ids) + 1, ids.offset * 4)
                flat = np.frombuffer(ids.buffers()[2], "<u2", (ends[-1] - ends[0]) // 2, ends[0])
                first = (ends[of] - ends[0]) // 2 + begin
                done = np.cumsum(n)
                wide = flat[np.repeat(first - (done - n), n) + np.arange(done[-1] if len(done) else 0)].astype("<u4")
                offsets = np.concatenate(([0], 4 * done)).astype(np.int32)
                cut_ids = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(wide)])
                rest = [pa.array(x.astype(np.int64)) for x in (lo // length, lo % length)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), pa.array(begin), pa.array(n), cut_ids, part.column(2).take(pa.array(of)), *rest], NAMES)

    return met.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id and ids of whole sequences (at most ``LENGTH`` tokens, so a group is small)."""
    inside = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return pieces.groupBy("sequence_id").agg(F.unhex(F.array_join(F.transform(inside, lambda p: p["ids"]), "")).alias("ids"))


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack(table(spark, sf_dir, "documents"), flatten=FLATTEN))
