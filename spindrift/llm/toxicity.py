"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Fitting uses at most ``TOXIC_ROWS`` and ``CLEAN_ROWS`` labelled rows, the first by hash of the id (a bounded
sample; weights restore the classes' shares). Three steps: a lexicon (words and word
beginnings that occur far more often in toxic rows, and by more than chance, counted in one aggregation; as large as the
sample makes it), features of the sample (each labelled
row is left out of the counts that score its own words), boosted trees on three quarters of it and isotonic
calibration on the rest, whose steps are joined by straight lines between their middles so that it keeps the order of the
trees. Then every document is scored in one pass without a shuffle.

Labels come only from rows whose crc32(doc_id as text) mod 4 is not 2; labels, lang, source and doc_id
are never features. Without labels of both classes the score is the share of toxic labels, or 0.
A null or empty text has features of zero and is scored like any other. Repeated rows stay as they are; labels of a
repeated id count once (the largest), and of its texts the smallest is learned from. Texts are read whole, and other columns not at
all. An empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import partitions, table, written

TOXIC_ROWS = 6_000
CLEAN_ROWS = 14_000
#: Terms of the lexicon: at least this often in toxic rows, with this ratio of rates, and so many standard errors from equal rates.
SUPPORT = 2
RATIO = 8.0
ERRORS = 2.0
THRESHOLD = 0.3

# Insults and words of the second person.
INSULTS = set("idiot moron stupid dumb loser scum trash pathetic worthless disgusting clown jerk fool imbecile".split())
YOU = set("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre tú ti usted tuyo".split())

_WORD = re.compile(r"[^\W_]+(?:[*@$!1][^\W_]+)*")
#: Letters, signs, letters: from where letters begin, and without giving back, so that a long word is read once.
_OBSCURED = re.compile(r"(?<![^\W\d_])[^\W\d_]++[*@$!013457]++[^\W\d_]++")
_SPACED = re.compile(r"(?:\b[^\W\d_][ .*_-]){3,}")
_STRETCH = re.compile(r"([^\W\d_])\1\1")
FEATURES = ["hit_rate", "hits", "kinds", "strongest", "strength", "insult_rate", "near_you", "you_rate", "capitals", "exclaims", "punctuation", "obscured", "spaced", "stretched", "log_words", "word_length"]


def _terms(word: str) -> list[str]:
    return [word, f"{word[:5]}-", f"{word[:4]}-"] if len(word) > 5 else [word]


def features(text: str, lexicon: dict[str, tuple[int, int]], totals: tuple[int, int], label: int | None = None) -> list[float]:
    """Features of a text; ``label`` takes the text itself out of the lexicon's counts."""
    import math
    from bisect import bisect_left

    words = _WORD.findall(text.lower())
    n = max(1, len(words))
    less = (label == 1, label == 0)
    hits, kinds, near, strongest, strength = 0, set(), 0, 0.0, 0.0
    you = [i for i, w in enumerate(words) if w in YOU]
    cache: dict[str, float] = {}
    for i, w in enumerate(words):
        odds = cache.get(w)
        if odds is None:
            odds = 0.0
            for t in _terms(w):
                if c := lexicon.get(t):
                    a, b = c[0] - less[0], c[1] - less[1]
                    if a >= SUPPORT:
                        odds = max(odds, math.log((a + 0.5) / (totals[0] + 1)) - math.log((b + 0.5) / (totals[1] + 1)))
            cache[w] = odds
        if odds > 2.0:
            hits += 1
            kinds.add(w)
            at = bisect_left(you, i - 5)
            near += at < len(you) and you[at] <= i + 5
            strongest = max(strongest, odds)
            strength += odds
    letters = max(1, sum(map(str.isalpha, text))) if text else 1
    return [
        100.0 * hits / n, math.log1p(hits), math.log1p(len(kinds)), strongest, strength / n,
        100.0 * sum(w in INSULTS for w in words) / n, 100.0 * near / n, 100.0 * len(you) / n,
        sum(map(str.isupper, text)) / letters, 100.0 * text.count("!") / n, 100.0 * sum(map(text.count, ".,;:?")) / n,
        100.0 * len(_OBSCURED.findall(text)) / n, 100.0 * len(_SPACED.findall(text)) / n, 100.0 * len(_STRETCH.findall(text)) / n,
        math.log1p(len(words)), sum(map(len, words)) / n,
    ]


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning; a row without an id is not held out, and has no label."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic and weight of the labelled rows that fit: never held-out ones."""
    marks = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = written(marks, "labels")
    order = F.xxhash64("doc_id", F.lit(2))
    classes = []
    for toxic, most in ((1, TOXIC_ROWS), (0, CLEAN_ROWS)):
        own = marks.where(F.col("toxic") == toxic)
        n = own.count()
        classes.append(own.orderBy(order, "doc_id").limit(most).withColumn("weight", F.lit(float(max(1, n)) / max(1, min(n, most)))))
    chosen = written(classes[0].union(classes[1]), "sample")
    text = F.coalesce(F.col("text"), F.lit(""))
    once = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id")  # bounded by the two limits
    return written(once.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"), F.first("weight").alias("weight")), "sample-texts")


def learn_lexicon(sample: DataFrame) -> tuple[dict[str, tuple[int, int]], tuple[int, int]]:
    """Terms with their counts of toxic and clean rows, and the rows of both classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, toxic = [], []
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = {t for w in set(_WORD.findall(text.lower())) for t in _terms(w)}
                terms += own
                toxic += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(toxic, pa.int32())], ["term", "toxic"])

    sums = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("t"), F.count("*").alias("n")).collect()[0]
    n_toxic, n_clean = int(sums["t"]), int(sums["n"] - sums["t"])
    counts = sample.select("text", F.col("toxic").cast("int")).mapInArrow(run, "term string, toxic int").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    ratio = ((F.col("a") + 0.5) / (n_toxic + 1)) / ((F.col("b") + 0.5) / (n_clean + 1))
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    top = counts.where((F.col("a") >= SUPPORT) & (ratio >= RATIO) & (F.log(ratio) >= ERRORS * error)).collect()  # of the bounded sample
    return {r["term"]: (int(r["a"]), int(r["b"])) for r in top}, (n_toxic, n_clean)


def _featured(rows: DataFrame, lexicon: dict, totals: tuple[int, int], labelled: bool) -> DataFrame:
    """``rows`` (doc_id, text and, if labelled, toxic and weight) with a column for each feature."""
    held = rows.sparkSession.sparkContext.broadcast(lexicon)
    kept = ["doc_id", *(["toxic", "weight"] if labelled else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = b.column("toxic").to_pylist() if labelled else [None] * b.num_rows
            values = [features(t, held.value, totals, y) for t, y in zip(b.column("text").to_pylist(), marks, strict=True)]
            columns = [pa.array([v[i] for v in values], pa.float64()) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *columns], [*kept, *FEATURES])

    schema = "doc_id long, " + ("toxic int, weight double, " if labelled else "") + ", ".join(f"{f} double" for f in FEATURES)
    return rows.select("doc_id", "text", *kept[1:]).mapInArrow(run, schema)


def middles(bounds: list[float], values: list[float]) -> tuple[list[float], list[float]]:
    """Middles of the level stretches of an isotonic curve, and their values."""
    xs, ys = [], []
    i = 0
    while i < len(bounds):
        j = i
        while j + 1 < len(bounds) and values[j + 1] == values[i]:
            j += 1
        xs.append((bounds[i] + bounds[j]) / 2)
        ys.append(values[i])
        i = j + 1
    return xs, ys


def on_curve(raw: Column, xs: list[float], ys: list[float]) -> Column:
    """Straight lines between the points; level beyond them."""
    points = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in zip(xs, ys, strict=True)])
    at = F.size(F.filter(points, lambda p: p["x"] <= raw))
    a, b = F.get(points, F.greatest(at - 1, F.lit(0))), F.get(points, F.least(at, F.lit(len(xs) - 1)))
    share = F.when(b["x"] > a["x"], (raw - a["x"]) / (b["x"] - a["x"])).otherwise(0.0)
    return a["y"] + F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * (b["y"] - a["y"])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score of every row of ``docs``."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    sample = sampled(docs, labels)
    lexicon, totals = learn_lexicon(sample)
    if not all(totals):
        return whole.select("doc_id", F.lit(1.0 if totals[0] else 0.0).alias("score"))
    gather = VectorAssembler(inputCols=FEATURES, outputCol="features")
    rows = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("toxic").cast("int").alias("toxic"), "weight")
    fitted = written(_featured(rows.repartition(2 * partitions(docs.sparkSession), "text"), lexicon, totals, True), "sample-features").withColumn("label", F.col("toxic").cast("double"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4))
    fit, calibrate = fitted.where(part != 0), fitted.where(part == 0)
    if fit.select("label").distinct().count() < 2 or calibrate.select("label").distinct().count() < 2:
        fit = calibrate = fitted  # too few labels for two parts
    trees = GBTClassifier(labelCol="label", weightCol="weight", maxIter=20, maxDepth=3, stepSize=0.2, seed=2).fit(gather.transform(fit))
    rated = lambda x: trees.transform(gather.transform(x)).withColumn("raw", vector_to_array("probability")[1])
    curve = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight", predictionCol="score").fit(rated(calibrate).select("raw", "label", "weight"))
    made = rated(_featured(whole, lexicon, totals, False)).drop("features", "rawPrediction", "probability", "prediction")
    xs, ys = middles(list(map(float, curve.boundaries)), list(map(float, curve.predictions)))
    return made.select("doc_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), on_curve(F.col("raw"), xs, ys))).alias("score"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
