"""Submissions: scoring of test results, progress, history and what a solver may see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def progress_by_exercise(exercises: DataFrame, submissions: DataFrame) -> DataFrame:
    """Every (exercise_id, user_id) of ``exercises``: that user's count, latest and best score, completed."""
    newest = F.struct("created_at", "id")
    keys = ["exercise_id", "user_id"]
    made = submissions.groupBy(*keys).agg(F.count("*").alias("n"), F.max("score").alias("best_score"), F.max_by("score", newest).alias("latest_score"))
    met = exercises.select(*keys).join(made, keys, "left")
    return met.select(*keys, F.coalesce("n", F.lit(0)).alias("n_submissions"), "best_score", "latest_score", F.coalesce(F.col("best_score") == 100, F.lit(False)).alias("completed"))


def join_progress(exercises: DataFrame, progress: DataFrame) -> DataFrame:
    """``exercises`` with the progress (has_submitted, latest_score, n_submissions, completed) of their owner, or its default."""
    met = exercises.join(progress, ["exercise_id", "user_id"], "left")
    n = F.coalesce("n_submissions", F.lit(0))
    return met.select(*exercises.columns, (n > 0).alias("has_submitted"), n.alias("n_submissions"), "latest_score", F.coalesce("completed", F.lit(False)).alias("completed"))


def filter_owner(exercises: DataFrame, user: int, exercise: int | None = None) -> DataFrame:
    """A user's rows, or the one of these with an id."""
    own = exercises.where(F.col("user_id") == user)
    return own if exercise is None else own.where(F.col("exercise_id") == exercise)


def filter_topic_difficulty(exercises: DataFrame, topic: str = "", difficulty: str = "all") -> DataFrame:
    """Rows whose topic contains the trimmed words in any case (empty: all) and whose difficulty is the one given (``all``: any)."""
    wanted = topic.strip().lower()
    rows = exercises.where(F.contains(F.lower("topic"), F.lit(wanted))) if wanted else exercises
    return rows if difficulty == "all" else rows.where(F.col("difficulty") == difficulty)


def latest_submission(submissions: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("exercise_id", "user_id").orderBy(F.desc("created_at"), F.desc("id")))
    return submissions.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def list_submissions(submissions: DataFrame) -> DataFrame:
    """Place of each submission in its (exercise, user) history, newest first."""
    rank = F.row_number().over(Window.partitionBy("exercise_id", "user_id").orderBy(F.desc("created_at"), F.desc("id")))
    return submissions.withColumn("place", rank)


def output_match(output: Column, expected: Column, exit_code: Column, timed_out: Column) -> Column:
    bare = lambda c: F.regexp_replace(c, "^\\s+|\\s+$", "")
    return (exit_code == 0) & ~timed_out & (bare(output) == bare(expected))


# What is said of submissions that can't be run or tested.
EMPTY = "Codul trimis este gol."
NOT_COMPILED = "Codul nu a putut fi compilat."
NO_TESTS = "Nu există teste disponibile pentru evaluare."


def score_submission(results: DataFrame, submissions: DataFrame | None = None) -> DataFrame:
    """score, passed, total, status and feedback of submissions from ``results`` (submission_id, test_no, passed, error).

    ``submissions``: submission_id, code and compile_error (null: it compiled). Empty code or an error of the compiler is a
    compilation_error with no test passed and the total kept; a submission without tests has failed. Without it, those that have results.
    """
    got = results.groupBy("submission_id").agg(F.count_if("passed").alias("ok"), F.count("*").alias("n"), F.max_by("error", F.when(F.col("error").isNotNull(), F.col("test_no"))).alias("last"))
    if submissions is None:
        met = got.withColumn("broken", F.lit(None).cast("string"))
    else:
        said = F.trim("compile_error")
        broken = F.when(F.col("code").rlike("^\\s*$"), F.lit(EMPTY)).when(said.isNotNull(), F.when(said == "", F.lit(NOT_COMPILED)).otherwise(said))
        met = submissions.select("submission_id", broken.alias("broken")).join(got, "submission_id", "left")
    n = F.coalesce("n", F.lit(0))
    ok = F.when(F.col("broken").isNull(), F.coalesce("ok", F.lit(0))).otherwise(0)
    status = F.when(F.col("broken").isNotNull(), "compilation_error").when(n == 0, "failed").when(F.col("last").isNotNull() & (ok == 0), "runtime_error").when(ok == n, "passed").when(ok == 0, "failed").otherwise("partial")
    score = F.when(n == 0, 0).otherwise(F.bround(100.0 * ok / F.greatest(n, F.lit(1)), 0).cast("int"))
    feedback = F.coalesce("broken", F.when(n == 0, F.lit(NO_TESTS)), F.when(status == "runtime_error", F.col("last")))
    return met.select("submission_id", score.alias("score"), ok.alias("n_passed"), n.alias("n_total"), status.alias("status"), feedback.alias("feedback"))


def unlock_solution(exercises: DataFrame, submissions: DataFrame, user: Column) -> DataFrame:
    """not_found for another's exercise, locked before a submission, else ok."""
    tried = submissions.select("exercise_id", "user_id").distinct().withColumn("tried", F.lit(True))
    met = exercises.withColumn("asker", user).join(tried.withColumnRenamed("user_id", "asker"), ["exercise_id", "asker"], "left")
    state = F.when(~F.col("asker").eqNullSafe(F.col("owner")), "not_found").when(F.col("tried").isNull(), "locked").otherwise("ok")
    return met.select("exercise_id", "asker", state.alias("state"))


def safe_projection(exercises: DataFrame) -> DataFrame:
    """id and the public tests only, without their marks."""
    public = F.transform(F.filter("test_cases", lambda t: ~t["is_hidden"]), lambda t: F.struct(t["input"].alias("input"), t["expected_output"].alias("expected_output")))
    return exercises.select("id", public.alias("test_cases"))
