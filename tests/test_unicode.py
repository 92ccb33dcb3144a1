"""Unicode forms against Python's own database."""

import re
import unicodedata

from pyspark.sql import functions as F

from spindrift.functions import text as T


def points():
    """All code points that both databases know, in lines of words of one."""
    return [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) not in ("Cn", "Co")]


def wanted(t):
    return re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", t).casefold())


def test_fold_text_of_all_code_points(spark):
    rows = [(i, c) for i, c in enumerate(points())]
    got = spark.createDataFrame(rows, "id int, t string").select("id", T.fold_text(F.col("t")).alias("f")).collect()
    bad = [(rows[r.id][1], r.f) for r in got if r.f != unicodedata.normalize("NFKD", rows[r.id][1]).encode("ascii", "ignore").decode().lower()]
    assert not bad


def test_tokens_of_all_code_points_and_their_decompositions(spark):
    from itertools import chain

    both = chain.from_iterable((c, unicodedata.normalize("NFD", c)) if not "가" <= c <= "힣" else (c,) for c in points())
    rows = list(enumerate(dict.fromkeys(both)))
    # letters that Spark's Java doesn't know yet are no letters there
    got = spark.createDataFrame(rows, "id int, t string").select("id", T.tokens(F.col("t")).alias("w"), F.expr("t rlike '\\\\p{Cn}'").alias("new")).collect()
    bad = [(rows[r.id][1], r.w, wanted(rows[r.id][1])) for r in got if not r.new and r.w != wanted(rows[r.id][1])]
    assert not bad, (len(bad), bad[:20])


def test_tokens_of_texts(spark):
    texts = ["Straße ﬁn ½ x²", "ậb ậ ́x", "ΑΣ ὈΔΥΣΣΕΎΣ", "ﬀ́ été", "snake_case 1_000", "", "\U0001d400\U0001d401 Ⅷ", "ো ｶﾞ", "İstanbul ǅ", "plain „quoted“ text’s"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "id int, t string").select("id", T.tokens(F.col("t")).alias("w")).collect()
    assert {r.id: r.w for r in got} == {i: wanted(t) for i, t in enumerate(texts)} | {99: []}
    assert spark.range(1).select(T.fold_text(F.lit(None).cast("string")).alias("f")).collect()[0].f is None
