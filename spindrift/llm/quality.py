"""Quality rules as a bitmask ledger (native).

Every rule is evaluated once; its failure is a bit of ``failure_bits`` and what it measured
stays in columns beside it. Policies are versioned masks over those bits, so that a new policy
or an ablation is a bitwise aggregation of the ledger and never reads a text again.

Nulls, empty texts and texts of white space have no words: all measurements are 0 and
``too_few_words`` fails. Rows are independent: repeated rows and repeated or null ids come out
as often as they went in. Other columns of the input are not read, whatever their names; in
``ledger`` a column with the name of a measurement gives way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import SPACE_RUN, SPACES, let, table

SYMBOLS = "[#*$%&|<>]"
WINDOW = 8

#: Rules in bit order. All are in whole numbers, so that any engine decides alike.
RULES: list[tuple[str, str]] = [
    ("too_few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("many_symbols", "100 * n_symbols > 10 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("long_words", "word_chars > 12 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("shouting", "100 * n_upper_runs > 50 * n_words"),
    ("exclamations", "100 * n_exclamations > 50 * n_words"),
    ("no_letters", "100 * n_letter_runs < 60 * n_words"),
]
BASE = ("too_few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """Rules that reject a document; a version is never changed once it has been used."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [n for n, _ in RULES]
        return sum(1 << names.index(r) for r in self.rules)


POLICIES = [
    Policy("base-1", BASE),
    Policy("web-1", tuple(n for n, _ in RULES)),
    Policy("lenient-1", ("too_few_words", "repeated_windows", "many_symbols", "shouting")),
]
PRODUCTION = POLICIES[1]


def _repeat_words(hashes: Column) -> Column:
    """Words inside 8-word windows that occur twice or more, from the words' hashes.

    Most texts have no such window: counting distinct windows shows that, and only the
    others sort their windows to find which ones repeat.
    """

    def covered(win: Column) -> Column:
        def marked(order: Column) -> Column:
            same = lambda s, j: F.coalesce(F.get(order, j)["h"] == s["h"], F.lit(False))
            twice = F.filter(order, lambda s, j: same(s, j - 1) | same(s, j + 1))
            starts = F.array_sort(F.transform(twice, lambda s: s["i"]))
            zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
            step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last"))
            return F.aggregate(starts, zero, step)["n"]

        order = F.array_sort(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0)).otherwise(let(order, marked))

    window = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    return let(hashes, lambda h: F.when(F.size(h) <= WINDOW, F.lit(0)).otherwise(let(window(h), covered)))


def _measured(docs: DataFrame) -> DataFrame:
    """``row`` (all of a row of ``docs``), the measurements and ``failure_bits``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))

    def measures(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(F.transform(w, lambda x: F.xxhash64(x))).cast("long").alias("n_repeat_words"),
        )

    of_lines = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    found = docs.select(
        F.struct("*").alias("row"),
        let(words, measures).alias("of_words"),
        let(lines, of_lines).alias("of_lines"),
        F.struct(
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            F.regexp_count(text, F.lit("!")).cast("long").alias("n_exclamations"),
            F.regexp_count(text, F.lit("[A-Z][A-Z]+")).cast("long").alias("n_upper_runs"),
            F.regexp_count(text, F.lit("\\p{L}+")).cast("long").alias("n_letter_runs"),
        ).alias("of_text"),
    ).select("row", "of_words.*", "of_lines.*", "of_text.*")
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return found.withColumn("failure_bits", total.cast("long"))


def ledger(docs: DataFrame) -> DataFrame:
    """``docs`` with ``failure_bits`` and the measurements; nothing is shuffled."""
    return _measured(docs).select(*[F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in MEASURES], *MEASURES)


MEASURES = ["n_words", "word_chars", "n_repeat_words", "n_lines", "n_dup_lines", "n_symbols", "n_exclamations", "n_upper_runs", "n_letter_runs", "failure_bits"]


def kept(policy: Policy) -> Column:
    return F.col("failure_bits").bitwiseAND(F.lit(policy.mask)) == 0


def ablations(book: DataFrame, policies: list[Policy] = POLICIES) -> DataFrame:
    """For each policy and rule of it: how many documents fail the rule, fail it alone, and are kept with and without it.

    The ledger is counted by bit pattern first (at most 2 ** rules rows), then all is bitwise.
    """
    patterns = book.groupBy("failure_bits").agg(F.count("*").alias("n"))
    spark = book.sparkSession
    rows = [(p.version, p.mask, n, 1 << i) for p in policies for i, (n, _) in enumerate(RULES) if n in p.rules]
    plan = spark.createDataFrame(rows, "policy string, mask long, rule string, bit long")
    hit = F.col("failure_bits").bitwiseAND(F.col("mask"))
    return (
        patterns.join(F.broadcast(plan))  # both sides have a bound: 2 ** rules patterns, rules x policies rows
        .groupBy("policy", "rule")
        .agg(
            F.sum(F.when(F.col("failure_bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
            F.sum(F.when(hit == 0, F.col("n")).otherwise(0)).alias("n_kept"),
            F.sum(F.when(hit.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )


def quality_filter(docs: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """The documents that the policy keeps, with their own columns only."""
    return _measured(docs).where(kept(policy)).select("row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    base = sum(1 << i for i, (n, _) in enumerate(RULES) if n in BASE)
    return ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failure_bits").bitwiseAND(F.lit(base)) != 0).alias("base_failed"),
        kept(PRODUCTION).alias("kept"),
        "failure_bits", F.lit(PRODUCTION.version).alias("policy"),
    )


_BIT = "|".join(f"(CASE WHEN {rule} THEN {1 << i} ELSE 0 END)" for i, (_, rule) in enumerate(RULES))
OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0b\\f\\r]')) AS l
  FROM documents),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclamations,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         len(regexp_extract_all(t, '[A-Z][A-Z]+'))::BIGINT AS n_upper_runs,
         len(regexp_extract_all(t, '\\p{{L}}+'))::BIGINT AS n_letter_runs, w
  FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM m WHERE len(w) > 8),
h AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS s FROM g),
r AS (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
c AS (SELECT doc_id, count(DISTINCT k)::BIGINT AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM r) GROUP BY doc_id),
a AS (SELECT m.*, coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN c USING (doc_id)),
b AS (SELECT *, ({_BIT})::BIGINT AS failure_bits FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failure_bits & 3) <> 0 AS base_failed, failure_bits = 0 AS kept, failure_bits, '{PRODUCTION.version}' AS policy
FROM b
"""
