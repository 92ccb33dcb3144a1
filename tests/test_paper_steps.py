"""Papers are read in one pass, and short ways of the text steps give what the patterns give."""

import contextlib
import io as streams
import random

from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import corpus as C
from spindrift.operators import papers as A


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_papers_are_made_and_read_once(spark, monkeypatch):
    from spindrift.plans import corpus_queries as Q

    made, plain = [], A.kept
    monkeypatch.setattr(A, "kept", lambda rows, name: made.append(optimized(rows)) or plain(rows, name))
    Q.QUERIES["parse_grading"](spark, "/root/testdata/sf0.001")
    assert len(made) == 1 and made[0].count("Relation [") == 1 and made[0].count("ArrowEvalPython") == 1
    for name in ("split_sections", "split_items", "check_items"):
        p = optimized(Q.QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert p.count("SUBIECTUL\\s+") == 2 and p.count("ArrowEvalPython") == 1  # headings and bodies, once each


def test_an_audit_deals_no_texts(spark):
    papers = spark.createDataFrame([], A.read_papers(spark.createDataFrame([], "source string, text string")).schema)
    with contextlib.redirect_stdout(streams.StringIO()) as out:
        A.audit_records(papers).explain("extended")
    below = out.getvalue().split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert below.count("Join") == 1 and "size(kept" in below.split("Join", 1)[1]


def test_short_ways_equal_the_patterns(spark):
    rng = random.Random(4)
    bits = ["x", "1", " 2 ", "Limbajul Pascal", "limbajul C/C++", "Pagina 1 din 3", "3 / 4", "3٣ din ٤", "Ministerul Educa", "barem de evaluare şi de notare", "ă", "é", "(cid:1)", "£", "", "é", "a.", "  ", "   ", "\n", "\n\n", "\n\n\n", "\n\n\n\n", "\t", "\r\n", "\x85", " ", " "]
    texts = [None, *("".join(rng.choice(bits) + rng.choice(["\n", " ", ""]) for _ in range(rng.randrange(0, 12))) for _ in range(400))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")

    def pattern(t):  # the steps of the general way, each by its pattern
        for p, by in [("\r\n?", "\n"), (" ", " "), ("­", ""), *A.REPAIRS]:
            t = F.regexp_replace(t, p, by)
        lines = F.transform(F.split(t, "[\n\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: F.regexp_replace(F.regexp_replace(x, "[ \t]+", " "), r"(?U)^\s+|\s+$", ""))
        kept = F.filter(lines, lambda x: ~x.rlike(A.PAGE_LINE) & ~x.rlike("(?iU)^(?:" + "|".join(A.FORM_LINES) + ")"))
        return F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), "^\n+|\n+$", ""), "\n{3,}", "\n\n")

    import unicodedata

    composed = spark.createDataFrame([(i, None if t is None else unicodedata.normalize("NFC", t)) for i, t in enumerate(texts)], "id int, text string")
    want = {r.id: r.t for r in composed.select("id", pattern(F.col("text")).alias("t")).collect()}
    assert {r.id: r.text for r in A.normalize_extracted(df).collect()} == want
    bare = {r.id: (r.a, r.b) for r in df.select("id", T.bare(F.col("text")).alias("a"), F.regexp_replace("text", r"(?U)^\s+|\s+$", "").alias("b")).collect()}
    assert all(a == b for a, b in bare.values())


def test_simple_texts_take_the_short_way(spark):
    rows = [(False, "Științe ale naturii, ăâîșțşţĂÂÎȘȚŞŢ\n1. x"), (False, ""), (False, "x" * 100_000 + "ă" * 100_000), (True, "a\tb"), (True, "é"), (True, "x\u0301"), (True, "a\rb"), (True, "£"), (True, "(cid:1)"), (True, "x\x1c"), (True, "\u2028")]
    df = spark.createDataFrame(rows, "want boolean, t string")
    assert df.where(A.odd(F.col("t")) != F.col("want")).count() == 0


def test_stems_lose_no_label(spark):
    texts = ["graful", "grafic", "varfuri", "arce", "les", "le", "context", "vectorul de tati", "vector", "numar prim", "bac.txt", "sirul de caractere", "a. xb. b. c. d."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for rules in (C.TOPICS, C.STOPWORD_TOPICS, {"x": ["le|xy", "(?i)GRAF"]}):
        for patterns in rules.values():
            for p in patterns:
                assert df.where(C._found(F.col("t"), p) != F.col("t").rlike(p)).count() == 0
    assert df.select(C.classify_type(F.col("t")).alias("k")).where("k = 'multiple_choice'").count() == 1
