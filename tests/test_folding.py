"""Folding: texts are folded once, near letters by a short table, and papers are read as before."""

import contextlib
import io as streams
import random
import unicodedata

from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import corpus as C
from spindrift.operators import papers as A


def plan(df):
    with contextlib.redirect_stdout(streams.StringIO()) as out:
        df.explain("extended")
    return out.getvalue().split("== Analyzed Logical Plan ==")[1].split("== Optimized")[0]


def test_a_text_is_folded_once(spark):
    df = spark.createDataFrame([(1, "x")], "id int, raw string")
    for made in (A.classify_document(F.col("raw")), C.classify_topic(F.col("raw")), C.classify_type(F.col("raw")), T.fold_text(F.col("raw"))):
        assert plan(df.select(made.alias("m"))).split("\n+-")[0].count("raw#") == 1


def test_mixed_letters_fold_as_python_does(spark):
    rng = random.Random(5)
    some = "aZ 9\n\tșțăâîéÉßøĲŉǆ…‘’–½ªﬁ①Ⅷ가字Ω\u0301\u00a0\u2028\u0085\U0001d400"
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(0, 30))) for _ in range(300)]
    got = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", T.fold_text(F.col("t")).alias("f")).collect()
    assert {r.id: r.f for r in got} == {i: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower() for i, t in enumerate(texts)}


def test_shared_lines_and_sections(spark):
    shared = "Scrieți pe foaia de examen răspunsul pentru fiecare dintre cerințele următoare."
    body = f"\u00a0{shared}\u2003\n1. unu\n{shared.upper()}\nrest\n\n2. doi"
    r = spark.createDataFrame([(body, None)], "a string, b string").select(A.numbered_items(F.col("a")).alias("a"), A.numbered_items(F.col("b")).alias("b")).collect()[0]
    assert [(x.number, x.item) for x in r.a] == [(1, "1. unu\nrest"), (2, "2. doi")] and r.b is None
    texts = [(0, "SUBIECTUL I\nx\x01y\nSUBIECTUL al II-lea\n\nSUBIECTUL III"), (1, "none"), (2, "SUBIECTUL I\nSUBIECTUL I")]
    s = {r.id: r.s for r in spark.createDataFrame(texts, "id int, t string").select("id", A.split_sections(F.col("t")).alias("s")).collect()}
    assert [tuple(x) for x in s[0].sections] == [("I", "x\x01y"), ("II", ""), ("III", "")] and s[0].error is None
    assert s[1].error == "expected sections I, II, III; found none" and s[2].error == "duplicate section marker: I"
