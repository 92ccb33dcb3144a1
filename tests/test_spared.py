"""Texts are tokenized once, and what is unlike seldom meets."""

import random

from pyspark.sql import functions as F

from spindrift.operators import novelty as N


def test_frequent_words_make_no_pairs(spark):
    rng = random.Random(2)
    often = [f"often{i}" for i in range(30)]
    texts = [" ".join([*often, *(f"w{rng.randrange(10**6)}" for _ in range(30))]) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    keys = N._bands(df.select("id", F.transform(F.split("text", " "), lambda t: F.xxhash64(t)).alias("set")))
    assert keys.count() == 200 * N.BANDS
    assert keys.alias("x").join(keys.alias("y"), ["band", "key"]).where("x.id < y.id").select("x.id", "y.id").distinct().count() < 0.02 * 200 * 199 / 2
    assert N.minhash_candidates(df).count() == 0


def test_exact_match_reads_written_texts(spark):
    from spindrift.plans import queries as Q

    df = Q.QUERIES["exact_match"](spark, "/root/testdata/sf0.001")
    assert "regexp_extract_all" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_by_request_cut_each_text_once(spark):
    c = spark.createDataFrame([(1, 10, "one two three four five six", "a b c d e f"), (1, 11, "", None), (2, 12, "x y", "one")], "request_id int, candidate_id int, candidate string, solution string")
    r = spark.createDataFrame([(1, 5, "One two three four five 7"), (1, 6, "a b c d e f"), (3, 7, "x y")], "request_id int, reference_id int, reference string")
    got = N.pairs_by_request(c, r)
    assert "regexp_extract_all" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = N.pair_similarity(c.join(r, "request_id").drop("request_id"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect())) and got.count() == 4
