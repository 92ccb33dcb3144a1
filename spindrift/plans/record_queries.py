"""Files written and read again, records that are checked, and the limiter on a stream, bound to the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import corpus as C
from spindrift.operators import novelty as N
from spindrift.sources import io
from spindrift.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Records of one file of a written corpus.
PER_FILE = 1000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- files


def _arrays(rows: DataFrame, key: Column, value: Column, whole: Callable[[Column], Column]) -> str:
    """Writes ``value`` of the rows as JSON, ``PER_FILE`` keys to a file; returns the folder."""
    path = io.work_dir(rows.sparkSession, "records")
    files = rows.select(F.floor(key / PER_FILE).cast("long").alias("part"), value.alias("v")).groupBy("part").agg(F.to_json(whole(F.collect_list("v"))).alias("value"))
    files.write.partitionBy("part").text(path)
    return path


def _corpus(s: SparkSession, d: str) -> str:
    return _arrays(_read(s, d, "documents"), F.col("doc_id"), F.struct("doc_id", "text", "lang", "source"), lambda v: v)


@query("SELECT doc_id, text, lang, source FROM documents")
def read_corpus(s, d):
    return io.read_corpus(s, _corpus(s, d), "doc_id long, text string, lang string, source string").select("doc_id", "text", "lang", "source")


@query(f"SELECT DISTINCT doc_id // {PER_FILE} AS part FROM documents")
def scan_files(s, d):
    return io.scan_files(s, _corpus(s, d), ".TXT").select(F.regexp_extract("low", "/part=([0-9]+)/", 1).cast("long").alias("part"))


@query("SELECT 'q' || (vec_id // 20) AS query_id, 'g' || label AS group_id, label % 3 + 1 AS grade, vec_id::VARCHAR AS doc_id FROM embeddings")
def read_golden(s, d):
    block = F.floor(F.col("vec_id") / 20).cast("long")
    groups = _read(s, d, "embeddings").groupBy(block.alias("q"), "label").agg(F.collect_list(F.col("vec_id").cast("string")).alias("document_ids"))
    group = F.struct(F.concat(F.lit(" g"), "label").alias("id"), (F.col("label") % 3 + 1).alias("grade"), "document_ids")
    asked = groups.groupBy("q").agg(F.collect_list(group).alias("relevance_groups")).withColumn("id", F.concat(F.lit(" q"), "q", F.lit(" ")))
    path = _arrays(asked, F.col("q"), F.struct("id", "relevance_groups"), lambda v: F.struct(F.lit(1).alias("version"), v.alias("queries")))
    return io.read_golden(s, path)[1]


@query("SELECT doc_id, text, lang FROM documents")
def write_preview(s, d):
    path = io.work_dir(s, "corpus") + ".preview.json"
    io.write_preview(_read(s, d, "documents").select("doc_id", "text", "lang"), path)
    return s.read.schema("doc_id long, text string, lang string").json(path)


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY 1, 2")
def write_report(s, d):
    path = io.work_dir(s, "report")
    io.write_report(_read(s, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars")), path)
    return s.read.schema("lang string, source string, n long, n_chars long").json(path)


# ---- records


@query("SELECT o_orderkey AS id, array_to_string(list_transform(list_filter(range(1, o_orderkey % 6 + 4), lambda i: (o_orderkey + i) % 9 <> 0), lambda i: i || ':' || chr((97 + (o_orderkey + i) % 4)::INTEGER)), ',') AS answers FROM orders")
def compact_answers(s, d):
    k = F.col("o_orderkey")
    letter = lambda i: F.when((k + i) % 9 == 0, "x").otherwise(F.get(F.array(*map(F.lit, "abcd")), ((k + i) % 4).cast("int")))
    said = F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), k % 6 + 3), lambda i: F.concat(i, F.lit(" "), letter(i))), "\t")
    return _read(s, d, "orders").select(k.alias("id"), T.compact_answers(said).alias("answers"))


_WORDS = "regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[\\p{L}\\p{N}]+')"


@query(f"""WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    c AS (SELECT doc_id, array_to_string(w[1:(len(w) + 1) // 2], ' ') AS reference, [[array_to_string(w[1:2], ' '), coalesce(w[len(w)], '')], [array_to_string(w[len(w) - 1:len(w)], ' '), coalesce(w[1], '')]] AS cases FROM t)
    SELECT doc_id, len(list_filter(cases, lambda x: length(x[1]) >= 4 AND x[2] <> '' AND contains(reference, x[1]) AND contains(reference, x[2])))::INTEGER AS n_copied FROM c""")
def copied_test_cases(s, d):
    w, n = F.col("w"), F.size("w")
    pair = lambda a, b: F.struct(F.array_join(a, " ").alias("input"), F.coalesce(b, F.lit("")).alias("output"))
    last = F.slice(w, F.greatest(n - 1, F.lit(1)), 2)
    cases = F.array(pair(F.slice(w, 1, 2), F.get(w, n - 1)), pair(last, F.get(w, F.lit(0))))
    cut = _read(s, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("w"))
    ready = cut.select("doc_id", cases.alias("cases"), F.array_join(F.slice(w, F.lit(1), F.ceil(n / 2).cast("int")), " ").alias("reference"))
    return ready.select("doc_id", N.copied_test_cases(F.col("cases"), F.col("reference")).alias("n_copied"))


@query("""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_linenumber = 3 AND l_orderkey % 19 = 0 THEN repeat('9', 501) ELSE l_quantity::INTEGER::VARCHAR END AS i, l_returnflag || l_linestatus AS o FROM lineitem),
    a AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n, i, o) AS pos FROM l),
    m AS (SELECT *, row_number() OVER (PARTITION BY k, i, o ORDER BY pos) > 1 AS twice FROM a),
    g AS (SELECT k, count(*) AS c, count(*) FILTER (n <= 2) AS p, min(pos) FILTER (length(i) > 500) AS la, min(pos) FILTER (twice) AS ta FROM m GROUP BY k),
    r AS (SELECT o_orderkey AS k, coalesce(c, 0) AS c, coalesce(p, 0) AS p, la, ta FROM orders LEFT JOIN g ON k = o_orderkey)
    SELECT k AS id, CASE WHEN k % 10 = 0 THEN 'topic' WHEN k % 14 = 5 THEN 'difficulty' WHEN k % 11 = 0 THEN 'empty_statement' WHEN k % 12 = 1 THEN 'long_statement' WHEN k % 13 = 0 OR k % 23 = 0 THEN 'no_main' WHEN k % 17 = 0 THEN 'file_access'
      WHEN c < 4 OR c > 6 THEN 'test_count' WHEN p < 1 OR p > 2 THEN 'public_count' WHEN la IS NOT NULL AND (ta IS NULL OR la <= ta) THEN 'long_test' WHEN ta IS NOT NULL THEN 'duplicate_test' END AS broken FROM r""")
def validate_exercise(s, d):
    k, n = F.col("o_orderkey"), F.col("l_linenumber")
    given = F.when((n == 3) & (F.col("l_orderkey") % 19 == 0), F.repeat(F.lit("9"), F.lit(501))).otherwise(F.col("l_quantity").cast("int").cast("string"))
    case = F.struct("l_linenumber", given.alias("input"), F.concat("l_returnflag", "l_linestatus").alias("expected_output"), (n > 2).alias("is_hidden"))
    cases = _read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(case)).alias("test_cases"))
    rows = _read(s, d, "orders").select("o_orderkey").join(cases, "o_orderkey", "left").withColumn("test_cases", F.coalesce("test_cases", F.filter(F.array(case_like()), lambda c: F.lit(False))))
    asked = F.concat(F.lit("t"), k % 3)
    code = F.when(k % 13 == 0, "void f();").when(k % 23 == 0, "// int main()\nvoid f();").when(k % 17 == 0, "int main() { ifstream f; }").otherwise("int main() { return 0; }")
    return C.validate_exercise(rows.select(
        k.alias("id"), asked.alias("asked_topic"), F.when(k % 10 != 0, asked).alias("topic"), F.lit("easy").alias("asked_difficulty"), F.when(k % 14 == 5, "hard").otherwise("easy").alias("difficulty"),
        F.when(k % 11 == 0, " ").when(k % 12 == 1, F.repeat(F.lit("s"), F.lit(1801))).otherwise("s").alias("statement"), code.alias("solution"), F.lit("e").alias("explanation"), "test_cases",
    ))


def case_like() -> Column:
    """A test case of the right type, for orders without any."""
    return F.struct(F.lit(0).alias("l_linenumber"), F.lit("").alias("input"), F.lit("").alias("expected_output"), F.lit(False).alias("is_hidden"))


# ---- the limiter on a stream


@query()
def stream_rate_limit(s, d):
    """What the watermark has released once all events have been read; the rest waits for later events."""
    schema, out = _read(s, d, "events").schema, io.work_dir(s, "limited")
    events = s.readStream.schema(schema).parquet(f"{d}/events.parque[t]")  # a pattern, since a stream takes no single file
    limited = streams.stream_rate_limit(events.select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id"), 2, 86_400)
    limited.writeStream.format("parquet").option("path", out).option("checkpointLocation", io.work_dir(s, "limited-log")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema("key string, event_id long, allowed boolean").parquet(out)
