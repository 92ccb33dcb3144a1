"""Rules that label, exclude and check records of a corpus."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.text import each, fold_text, once

# Patterns of the topics over folded text.
TOPICS = {
    "pseudocode": [r"\bpseudocod\b"],
    "arrays": [r"\btablou unidimensional\b", r"\bvector(?:ul)?\b"],
    "matrices": [r"\bmatrice\b", r"\btablou bidimensional\b"],
    "strings": [r"\bsir(?:ul)? de caractere\b", r"\bcuv(?:a|i)nt(?:ul|e)?\b", r"\btext(?:ul)?\b"],
    "subprograms": [r"\bsubprogram(?:ul|e)?\b"],
    "recursion": [r"\brecursiv"],
    "graphs": [r"\bgraf(?:ul|uri)?\b", r"\bvarfuri\b", r"\barce\b", r"\bmuchii\b"],
    "trees": [r"\barbore(?:le)?\b", r"\bradacina\b", r"\bvector(?:ul)? de tati\b"],
    "divisibility": [r"\bdivizor(?:i|ii|ilor)?\b", r"\bnum(?:a|e)r prim\b", r"\bmultiplu\b"],
    "number processing": [r"\bcifr(?:a|e|elor)?\b", r"\bnumar natural\b"],
    "combinatorics/backtracking": [r"\bbacktracking\b", r"\bpermutar", r"\bcombinari\b"],
    "files": [r"\bfisier(?:ul)?\b", r"\bbac\.(?:in|out|txt)\b"],
}
PARENT_VECTOR = r"\bvector(?:ul)? de tati\b"
#: The rule table for the driver's invented languages: frequent words in the place of terms.
STOPWORD_TOPICS = {"english": [r"\bthe\b"], "german": [r"\bder\b"], "french": [r"\bles?\b"], "spanish": [r"\blos\b"]}


def _found(text: Column, pattern: str) -> Column:
    """Whether ``pattern`` is in ``text``. The letters it begins with are looked for first, as most texts lack them."""
    stem = re.match(r"(?:\\b)?([a-z ]+)(?![a-z ?*{|])", pattern)
    return F.contains(text, F.lit(stem[1])) & text.rlike(pattern) if stem and "|" not in re.sub(r"\([^()]*\)", "", pattern) else text.rlike(pattern)


def classify_topic(text: Column, rules: dict[str, list[str]] = TOPICS) -> Column:
    """The one label whose patterns match, else ``unclassified``."""
    return once(fold_text(text), lambda folded: topic_of(folded, rules))


def topic_of(folded: Column, rules: dict[str, list[str]] = TOPICS) -> Column:
    any_of = lambda patterns: reduce(or_, [_found(folded, p) for p in patterns])
    labels = F.array_compact(F.array(*[F.when(any_of(p), F.lit(name)) for name, p in rules.items()]))
    if "trees" in rules:
        labels = F.when(_found(folded, PARENT_VECTOR), F.array_remove(labels, "arrays")).otherwise(labels)
    return once(labels, lambda x: F.when(F.size(x) == 1, x[0]).otherwise("unclassified"))


def classify_type(text: Column) -> Column:
    return once(fold_text(text), type_of)


def type_of(folded: Column) -> Column:
    return (
        # the letter is told before what stands before it, which is dearer
        F.when(F.regexp_count(folded, F.lit(r"[a-d]\.(?<=\b..)")) >= 3, "multiple_choice")
        .when(F.contains(folded, F.lit("pseudocod")) & folded.rlike(r"\b[ab]\)"), "pseudocode_analysis")
        .when(F.contains(folded, F.lit("definitia completa a subprogramului")), "subprogram_implementation")
        .when(_found(folded, "scrie(?:ti)? programul"), "program_implementation")
        .otherwise("open_response")
    )


def extraction_gate(pages: DataFrame, least: int = 500) -> DataFrame:
    """``pages`` (source, page_no, text) by source: pages, blank pages, characters and the reason to reject."""
    bare = F.length(F.trim(F.coalesce(F.col("text"), F.lit(""))))
    out = pages.groupBy("source").agg(F.count("page_no").alias("n_pages"), F.array_join(F.array_sort(F.collect_list(F.when(bare == 0, F.col("page_no")))).cast("array<string>"), ",").alias("blank_pages"), F.sum(bare).alias("n_chars"))
    reason = F.when(F.col("n_pages") == 0, "no_pages").when(F.col("blank_pages") != "", "blank_page").when(F.col("n_chars") < least, "too_short")
    return out.withColumn("reject_reason", reason)


def page_text(html: Column) -> Column:
    """Text of a raw page: scripts, styles and tags out, white space as one space."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), "(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, "[ \\t\\n\\r]+", " "))


def strip_page_furniture(pages: DataFrame, headers: str = "^(?:Page|Pagina) ", foot: int = 2) -> DataFrame:
    """``pages`` (source, page_no, text) without header lines and lone page numbers in the last ``foot`` lines."""
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x, i: ~((i >= F.size(lines) - foot) & x.rlike("^\\s*[0-9]{1,3}\\s*$")) & ~x.rlike(headers))
    return pages.withColumn("text", F.array_join(kept, "\n"))


def split_items(docs: DataFrame) -> DataFrame:
    """id, number, item (with its number): the numbered items ``1. `` to ``9. `` at line starts of each text."""
    parts = F.filter(F.split("text", "(?m)^(?=[ \\t]*[1-9]\\.\\s)"), lambda x: x.rlike("^[ \\t]*[1-9]\\.\\s"))
    # where a line ends otherwise than by ASCII, the pattern also takes white space before that end
    bare = lambda x: F.when(x.rlike("[\\x{85}\\x{2028}\\x{2029}]\\z"), F.regexp_replace(x, "^\\s+|\\s+$", "")).otherwise(F.btrim(x, F.lit(" \t\n\x0b\f\r")))
    return each(docs.select("id", "text"), parts, "item").select("id", F.regexp_extract("item", "^[ \\t]*([1-9])", 1).cast("int").alias("number"), bare(F.col("item")).alias("item"))


def check_items(items: DataFrame, expected: int) -> DataFrame:
    """Of each id, whether its items are numbered 1 to ``expected`` in order."""
    got = items.groupBy("id").agg(F.array_sort(F.collect_list("number")).alias("numbers"))
    return got.select("id", F.size("numbers").alias("n_items"), (F.col("numbers") == F.sequence(F.lit(1), F.lit(expected))).alias("complete"))


def expected_counts(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """``rows`` (year, profile, section) with ``expected`` of the range that holds the year; ``ranges`` is a rule table."""
    on = (rows["year"] >= ranges["low"]) & (rows["year"] <= ranges["high"]) & (rows["profile"] == ranges["profile"]) & (rows["section"] == ranges["section"])
    return rows.join(F.broadcast(ranges), on, "left").select(rows["*"], ranges["expected"])


def pairing_audit(subjects: DataFrame, guides: DataFrame) -> DataFrame:
    """Rows of either side without a partner by year, profile, session and variant (nulls equal): side, source."""
    keys = ["year", "profile", "session", "variant"]

    def lone(a: DataFrame, b: DataFrame, side: str) -> DataFrame:
        x, y = a.alias("x"), b.select(*keys).distinct().alias("y")
        on = F.col("x.year").eqNullSafe(F.col("y.year"))
        for k in keys[1:]:
            on &= F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}"))
        return x.join(y, on, "left_anti").select(F.lit(side).alias("side"), "source")

    return lone(subjects, guides, "subject").union(lone(guides, subjects, "guide"))


def unique_ids_check(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def dedup_documents_by_id(files: DataFrame) -> DataFrame:
    """``files`` (prefix, path, id): path and whether it is skipped, since an accepted earlier file has one of its ids.

    Ids collide inside a prefix only, and acceptance depends on the files before, so each prefix is folded in order of path.
    """
    return accepted_files(files.groupBy("prefix", "path").agg(F.collect_set("id").alias("ids")), whole=True)


def accepted_files(files: DataFrame, whole: bool = False) -> DataFrame:
    """``dedup_documents_by_id`` of ``files`` (prefix, path, ids), of which each has all its ids in one row, if ``whole``."""
    each = files if whole else files.groupBy("prefix", "path").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    order = F.array_sort(F.collect_list(F.struct(F.lower("path").alias("low"), "path", "ids")))
    zero = F.struct(F.array().cast("array<string>").alias("taken"), F.array().cast("array<struct<path:string,skipped:boolean>>").alias("out"))

    def step(a: Column, f: Column) -> Column:
        clash = F.arrays_overlap(a["taken"], f["ids"])
        return F.struct(F.when(clash, a["taken"]).otherwise(F.concat(a["taken"], f["ids"])).alias("taken"), F.concat(a["out"], F.array(F.struct(f["path"].alias("path"), clash.alias("skipped")))).alias("out"))

    return each.groupBy("prefix").agg(order.alias("files")).select(F.explode(F.aggregate("files", zero, step)["out"]).alias("f")).select("f.path", "f.skipped")


# Limits of a generated row.
LIMITS = {"statement": 1800, "solution": 5000, "explanation": 1800}
TEST_VALUE = 500


def validate_exercise(rows: DataFrame) -> DataFrame:
    """id and the first rule that a row breaks (null: none).

    ``rows``: id, topic, difficulty, asked_topic, asked_difficulty, statement, solution, explanation, test_cases. Inside the
    tests, length and repetition are checked test by test, so the rule of the first bad test is the one reported.
    """
    from spindrift.functions.text import executable_contract

    cases, blank = F.col("test_cases"), lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    out = F.when(~F.col("topic").eqNullSafe(F.col("asked_topic")), "topic").when(~F.col("difficulty").eqNullSafe(F.col("asked_difficulty")), "difficulty")
    for c in LIMITS:
        out = out.when(blank(c), f"empty_{c}")
    for c, most in LIMITS.items():
        out = out.when(F.length(c) > most, f"long_{c}")
    contract = executable_contract(F.col("solution"))
    out = out.when(contract != "ok", contract)
    public = F.size(F.filter(cases, lambda t: ~t["is_hidden"]))
    out = out.when(~F.size(cases).between(4, 6), "test_count").when(~public.between(1, 2), "public_count")
    pairs = F.transform(cases, lambda t: F.struct(F.trim(t["input"]).alias("i"), F.trim(t["expected_output"]).alias("o")))
    long_at = F.array_min(F.transform(cases, lambda t, i: F.when((F.length(t["input"]) > TEST_VALUE) | (F.length(t["expected_output"]) > TEST_VALUE), i)))
    twice_at = F.array_min(F.transform(pairs, lambda p, i: F.when(F.array_position(pairs, p) <= i, i)))
    out = out.when(long_at.isNotNull() & (twice_at.isNull() | (long_at <= twice_at)), "long_test").when(twice_at.isNotNull(), "duplicate_test")
    return rows.select("id", out.alias("broken"))


def first_valid_attempt(attempts: DataFrame, most: int = 6) -> DataFrame:
    """``attempts`` (request_id, attempt, error): the first without an error, else the last error."""
    some = attempts.where(F.col("attempt") <= most)
    return some.groupBy("request_id").agg(F.min(F.when(F.col("error").isNull(), F.col("attempt"))).alias("attempt"), F.max_by("error", "attempt").alias("last_error")).select("request_id", "attempt", F.when(F.col("attempt").isNull(), F.col("last_error")).alias("error"))


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of each key with the greatest version (last write wins)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version)))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
