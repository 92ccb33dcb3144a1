"""Mixing sources to target weights by Poisson replication (native).

Each source gets a mean repetition rate: its target weight over its share of the corpus. A
document's count inverts the Poisson distribution of that mean at a number that its id and the
seed decide, so the same document gets the same count wherever it is read and however often a
task runs. Counts are exploded and all copies are shuffled globally by hash.

The measure of a source is its code points, one a document at least. A null source is the source ''.
Null ids draw by their text; repeated rows draw alike. A null text is empty. An empty table gives
an empty one. The columns come out as they went in, whatever their names, with ``copy`` (from 1; in place of a column
of that name) where asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import partitions, table, written

SEED = 20
#: Without given weights: share of the corpus to this power, scaled to sum to one.
FLATTEN = 0.7
#: Rates of so many sources at most are broadcast; with more, rates are joined by shuffling.
MOST_SOURCES = 10_000


def rates(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0) -> DataFrame:
    """source_key, rate and its cumulative Poisson distribution. ``weights``: by source (others: 0); ``size``: of the mixture, against the corpus."""
    length = F.greatest(F.lit(1), F.coalesce(F.length("text"), F.lit(0))).cast("long")
    totals = docs.select(F.coalesce(F.col("source"), F.lit("")).alias("source_key"), length.alias("n")).groupBy("source_key").agg(F.sum("n").alias("n"))
    totals = written(totals, "source-totals")
    if weights is None:
        given = totals.withColumn("weight", F.pow("n", F.lit(FLATTEN)))
    else:
        want = docs.sparkSession.createDataFrame(list(weights.items()), "source_key string, weight double")
        given = totals.join(F.broadcast(want), "source_key", "left").fillna(0.0, ["weight"])  # a parameter: bounded by the caller
    whole = given.agg(F.sum("n").alias("all_n"), F.sum("weight").alias("all_weight"))
    rate = F.lit(size) * F.col("weight") / F.col("all_weight") * F.col("all_n") / F.col("n")
    rated = given.join(F.broadcast(whole)).select("source_key", rate.alias("rate"))  # one row
    return rated.withColumn("cdf", _cdf(F.col("rate")))


def _cdf(rate: Column) -> Column:
    """P(count <= k) for k = 0, 1, ... as far as doubles tell it from one."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    zero = F.struct((-rate).alias("log_p"), F.array(F.exp(-rate)).alias("c"))

    def step(a: Column, k: Column) -> Column:
        log_p = a["log_p"] + F.log(rate) - F.log(k.cast("double"))
        return F.struct(log_p.alias("log_p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + F.exp(log_p))).alias("c"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), most), zero, step)["c"]).otherwise(F.array(F.lit(1.0)))


def _uniform(seed: int) -> Column:
    """A number in (0, 1) from 52 bits of the id's digest."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))
    return (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0, seed: int = SEED, with_copy: bool = False) -> DataFrame:
    spark = docs.sparkSession
    table_of = written(rates(docs, weights, size), "rates")
    if table_of.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES:
        table_of = F.broadcast(table_of)
    asked = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("source"), F.lit("")).alias("source_key"), _uniform(seed).alias("u"))
    counted = asked.join(table_of.select("source_key", "cdf"), "source_key").withColumn("n", F.size(F.filter("cdf", lambda c: c < F.col("u"))))
    copies = counted.where("n > 0").select("row", "u", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    place = F.xxhash64("u", "copy", F.lit(seed))
    shuffled = copies.select("row", "copy", place.alias("place")).repartition(partitions(spark), "place").sortWithinPartitions("place")
    own = [F.col("row")[c].alias(c) for c in docs.columns if not (with_copy and c.lower() == "copy")]
    return shuffled.select(*own, *(["copy"] if with_copy else []))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return mix(docs, with_copy=True)


OP6_SQL = f"""
WITH t AS (SELECT coalesce(source, '') AS k, sum(greatest(1, coalesce(length(text), 0)))::DOUBLE AS n FROM documents GROUP BY 1),
w AS (SELECT k, n, pow(n, {FLATTEN}) AS weight FROM t),
r AS (SELECT k, weight / (SELECT sum(weight) FROM w) * (SELECT sum(n) FROM w) / n AS rate FROM w),
p AS (SELECT k, i, sum(exp(-rate + i * ln(rate) - lgamma(i + 1.0))) OVER (PARTITION BY k ORDER BY i) AS c
      FROM (SELECT k, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 25)::BIGINT)) AS i FROM r)),
d AS (SELECT *, (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, text, '')), 1, 13))::BIGINT + 0.5) / {float(2**52)} AS u FROM documents),
n AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, count(*) AS many FROM d JOIN p ON p.k = coalesce(d.source, '') AND p.c < d.u GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, many + 1))::INTEGER AS copy FROM n
"""
