"""Removal of lines that many documents share.

Texts are split at line feeds. A line's key is the line without ASCII white space at both ends, A-Z in lower case. Lines
are exploded with their positions, keys are hashed (128 bits), and documents are counted for each hash.
Lines whose key has at least ``LEAST_CHARS`` code points and is found in at least ``LEAST_DOCS`` documents go, except in the
document with the largest doc_id that holds the key. What is left of a text is put together by position.

Only keys that are long enough are shuffled, as two longs instead of the line. Counting spreads by (hash, doc_id) first, so a key
that every document holds is counted in many tasks; the join back to the lines is a plain one, whose large
partitions Spark can split. Texts meet the positions to drop by row, and a row's work is in proportion to its length.

A null or empty text is one empty line. Documents are told by doc_id: rows that share one count once,
and each of them keeps or loses a line alike. Rows without an id count for no document and are never the largest, so they lose what is shared.
Repeated rows come out as often as they went in. An empty table gives an empty result. Other columns are carried by
``drop_lines`` whatever their names are, and are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import SPACES, let, table, written

LEAST_CHARS = 40
LEAST_DOCS = 5
_UPPER = "".join(map(chr, range(65, 91)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashed(text: Column, least: int) -> Column:
    """For each line long enough to be shared: its position and the two halves of its key's hash."""

    def entry(key: Column, at: Column) -> Column:
        h = F.struct(at.alias("at"), F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("g"))
        return F.when(F.char_length(key) >= least, h)

    lines = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), "\n", -1)
    return F.filter(F.transform(lines, lambda x, i: let(F.btrim(x, F.lit(SPACES)), lambda key: entry(key, i))), lambda e: e.isNotNull())


def shared_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """h, g (hash of a key), n_docs and keeper (the largest doc_id) of every key that enough documents hold."""
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array_distinct(F.transform(_hashed(F.col("text"), least_chars), lambda e: F.struct(e["h"].alias("h"), e["g"].alias("g"))))).alias("e"))
    counted = each.where("doc_id is not null").select("doc_id", "e.h", "e.g").groupBy("h", "g").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))
    return counted.where(F.col("n_docs") >= least_docs)


def _row(doc_id: Column, text: Column) -> list[Column]:
    """What names a row: rows of one id and one text lose the same lines."""
    return [F.coalesce(doc_id.cast("long"), F.lit(-1)).alias("id"), F.xxhash64(doc_id.isNull(), text).alias("of")]


def drop_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Every row as the struct ``row``, with its ``kept`` lines, ``n_lines`` and ``n_dropped``."""
    shared = written(shared_lines(docs, least_chars, least_docs), "shared-lines")
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    placed = own.select(F.col("doc_id").cast("long").alias("doc_id"), *_row(F.col("doc_id"), F.col("text")), F.explode(_hashed(F.col("text"), least_chars)).alias("e")).select("doc_id", "id", "of", "e.*")
    lost = placed.join(shared.select("h", "g", "keeper"), ["h", "g"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    gone = written(lost.groupBy("id", "of").agg(F.collect_set("at").alias("gone")), "lines-to-drop")
    met = own.select("*", *_row(F.col("doc_id"), F.col("text"))).join(gone, ["id", "of"], "left")
    lines = _lines(F.col("text"))
    kept = let(lines, lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone")), lambda i: x[i]))
    return met.select("row", F.when(F.col("gone").isNull(), lines).otherwise(kept).alias("kept"), F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines that many documents share taken out of their texts; null texts stay null."""
    fields = [F.when(F.col("row.text").isNotNull(), F.array_join("kept", "\n")).alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    return drop_lines(docs).select(*fields)


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_lines(table(spark, sf_dir, "documents"))
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"))


OP12_SQL = """
WITH own AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
placed AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM own),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM placed),
shared AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
told AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.keeper AS gone FROM keyed k LEFT JOIN shared s USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM told GROUP BY r
"""
