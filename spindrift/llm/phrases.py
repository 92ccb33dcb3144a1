"""Phrases of two to four words that stand together more often than their parts, for each language.

**Counting.** Every word of a piece begins one window of the longest order, four lead columns w0 to w3 (the words that follow, an
empty string where the piece ends). Only these windows are counted: equal ones are added up over all tasks first, and ``ROLLUP``
over (lang, w0, w1, w2, w3) sums them to all shorter prefixes, so that one pass gives the count of words in a language, of each
word, and of each phrase of two, three and four words.

**What is not counted.** Nearly all windows of a corpus are met once, and would be shuffled whole to be
thrown away. A phrase is a candidate from ``LEAST`` occurrences on, and so is every part of it; so a window may end before a word with which its last
two, or three, words make a rarer phrase, and rare words alone are only summed. Which ones are rare is told by bitmaps
of hashes of what is frequent, of ``BITS`` bits whatever the data: counts of hashed words and pairs give the first,
counts of hashed triples whose pairs are both frequent the second. Hashes that collide let a rare phrase through, which ``ROLLUP`` then
counts as any other; no frequent one is ever lost. Once a bitmap is full (some 10^8 frequent phrases) it spares nothing and
the work is still linear in the data.

**Scores.** A candidate (count a) cut after k words has parts with counts l and r: floor(2,000,000 a / (l + r)) in decimals of 38
digits; the lowest cut counts, of equal ones the smallest k. A candidate inside a longer one that has 80 % of its occurrences
goes. The first ``TOP`` of a language are found in salted groups before they meet.

A null text is empty, a null lang is ``und``. Repeated rows and ids count as often as they occur; doc_id and other columns are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.llm.common import table, written

ORDER = 4
LEAST = 30
TOP = 2000
#: Bits of a bitmap as a power of two.
BITS = 27
#: Bytes of text that are counted together.
CHUNK = 1 << 20
#: Hashes that a task adds up before it hands them on.
HELD = 1 << 19
_SALTS = 64
_BLOCK = 1 << 19
#: The bits of a hash that are shuffled: more than a bitmap tells apart, and a collision only lets a rare phrase through.
_KEPT = 0xFFFFFFFFFF000000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_STOPS = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
#: An odd number, and what it is multiplied with to give 1 (modulo 2^64).
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Words:
    """The words of a chunk of texts: where each lies in ``raw``, its ``lang`` (number), and ``joined``: the next one is of the same piece."""

    def __init__(self, langs: list[str], texts: list[bytes]) -> None:
        import numpy as np

        self.langs = sorted(set(langs))
        number = {x: i for i, x in enumerate(self.langs)}
        self.raw = (b"\n".join(texts) + b"\n").translate(_LOWER).translate(_STOPS)
        self.bytes = np.frombuffer(self.raw, np.uint8)
        stop = self.bytes == 10
        gap = stop | (self.bytes == 32)
        edge = (np.flatnonzero(gap[1:] != gap[:-1]) + 1).astype(np.int32)
        if not gap[0]:
            edge = np.concatenate((np.zeros(1, np.int32), edge))
        self.edge = edge  # the chunk ends with a gap, so every word has an end
        self.starts, self.ends = edge[0::2], edge[1::2]
        piece = np.cumsum(stop, dtype=np.int32)[self.starts]
        self.joined = np.append(piece[1:] == piece[:-1], np.zeros(min(1, len(piece)), bool))
        size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        words = np.diff(np.append(np.searchsorted(self.starts, np.cumsum(size) - size), len(self.starts)))
        self.lang = np.repeat(np.fromiter((number[x] for x in langs), np.int32, len(langs)), words)

    def named(self, which):
        """Numbers of the words at the places ``which``, and the different words."""
        import numpy as np

        offsets = np.concatenate((np.zeros(1, np.int32), self.edge))
        runs = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(self.raw))
        found = runs.take(pa.array(2 * which + 1)).dictionary_encode()
        return found.indices.to_numpy(), found.dictionary

    def hashes(self, triples: bool) -> list:
        """Hashes of the word, of the pair (and of the triple) that begins at each word; words of a language have hashes of their own.

        A word's is the value of its bytes as digits to the base ``_BASE`` (modulo 2^64): differences of running sums, all brought to one power."""
        import numpy as np
        import xxhash

        h, lo, n = np.zeros(len(self.starts), np.uint64), 0, len(self.starts)
        while lo < n:  # in blocks, so that little is held beside the hashes
            begin = int(self.starts[lo])
            hi = max(lo + 1, int(np.searchsorted(self.starts, begin + _BLOCK)))
            own = self.bytes[begin : int(self.ends[hi - 1])]
            upto = np.cumsum((own.astype(np.uint64) + np.uint64(1)) * _powers(len(own))[: len(own)], dtype=np.uint64)
            first, last = self.starts[lo:hi] - begin, self.ends[lo:hi] - begin - 1
            before = np.where(first > 0, upto[first - 1], np.uint64(0))
            h[lo:hi] = (upto[last] - before) * _powers(len(own), _INVERSE)[first]
            lo = hi
        h = _spread(h)
        of = np.fromiter((xxhash.xxh64_intdigest(x.encode(), 1) for x in self.langs), np.uint64, len(self.langs))
        out = [_spread(h ^ of[self.lang])]
        for j in (1, 2)[: 1 + triples]:
            after = np.concatenate([h[j:], np.zeros(min(j, len(h)), np.uint64)])
            out.append(_spread(out[-1] + after * np.uint64(_BASE)))
        return [x & np.uint64(_KEPT) for x in out]


_made: dict[int, object] = {}


def _powers(n: int, base: int = 0):
    """Powers of ``base`` modulo 2^64 from the zeroth, kept in the worker process."""
    import numpy as np

    base = base or _BASE
    if base not in _made or len(_made[base]) < n:
        out = np.full(n + n // 4 + 1, base, np.uint64)
        out[0] = 1
        _made[base] = np.multiply.accumulate(out)
    return _made[base]


def _after(x):
    import numpy as np

    return np.append(x[1:], np.zeros(min(1, len(x)), bool))


def _spread(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """Of about ``CHUNK`` bytes each; a text is not split."""
    langs: list[str] = []
    texts: list[bytes] = []
    held = 0
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                langs.append(lang)
                texts.append(text)
                held += len(text) + 1
                if held >= CHUNK:
                    yield Words(langs, texts)
                    langs, texts, held = [], [], 0
    if texts:
        yield Words(langs, texts)


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _bitmap(counts: DataFrame, least: int, bits: int):
    """The broadcast bitmap of the hashes (h) that are counted (n) ``least`` times or more: 2^bits bits, whatever the data."""
    import numpy as np

    at = F.shiftrightunsigned("h", 64 - bits) + 1  # Spark counts positions from one
    often = counts.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select(at.alias("at"))
    blocks = often.groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    whole = np.zeros(max(1 << bits >> 3, 4096), np.uint8)
    for r in blocks.toLocalIterator():
        whole[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return counts.sparkSession.sparkContext.broadcast(whole.tobytes())


def _holds(bitmap, h, bits: int):
    import numpy as np

    at = h >> np.uint64(64 - bits)
    return (np.frombuffer(bitmap.value, np.uint8)[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _counted(found: Iterator) -> Iterator[pa.RecordBatch]:
    """Hashes and how often each is met, from arrays of hashes; what a task hands on is added up as far as ``HELD`` allows."""
    import numpy as np

    def added(h, n):
        order = np.argsort(h)
        h, n = h[order], n[order]
        first = np.flatnonzero(np.append(np.ones(min(1, len(h)), bool), h[1:] != h[:-1]))
        return h[first], np.add.reduceat(n, first) if len(first) else n

    def out(h, n):
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    h, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for values in found:
        x = np.sort(values)
        first = np.flatnonzero(np.append(np.ones(min(1, len(x)), bool), x[1:] != x[:-1]))
        h, n = added(np.concatenate([h, x[first]]), np.concatenate([n, np.diff(np.append(first, len(x)))]))
        if len(h) > HELD:
            yield out(h, n)
            h, n = h[:0], n[:0]
    if len(h):
        yield out(h, n)


def windows(docs: DataFrame, least: int = LEAST, bits: int = BITS) -> DataFrame:
    """lang, w0 to w3 and n: the longest windows, ended where they can't be part of a phrase of ``least`` occurrences. A rare word's is four empty strings."""
    read = _read(docs)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def found():
            for c in _chunks(batches):
                one, two = c.hashes(False)
                yield np.concatenate([one, two[c.joined]])

        return _counted(found())

    first = _bitmap(read.mapInArrow(pairs, "h long, n long"), least, bits)

    def ties(c: Words, one, two):
        """Which words are frequent, and which are so with the next one."""
        known = _holds(first, one, bits)
        return known, c.joined & known & _after(known) & _holds(first, two, bits)

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for c in _chunks(batches):
                one, two, three = c.hashes(True)
                _, tied = ties(c, one, two)
                yield three[tied & _after(tied)]

        return _counted(found())

    second = _bitmap(read.mapInArrow(triples, "h long, n long"), least, bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        names = ["lang", "w0", "w1", "w2", "w3"]
        for c in _chunks(batches):
            one, two, three = c.hashes(True)
            known, tied = ties(c, one, two)
            third = tied & _after(tied) & _holds(second, three, bits)
            fourth = third & _after(third)
            at = np.flatnonzero(known)
            code, said = c.named(at)
            place = np.zeros(len(known) + ORDER, np.int32)
            place[at] = code
            pad, langs = len(said), len(c.langs)
            # a word that ends its window, by itself; words that are rare, together
            alone = np.bincount(np.where(known, place[: len(known)], pad)[~tied] * langs + c.lang[~tied], minlength=(pad + 1) * langs)
            some = np.flatnonzero(alone)
            ended = np.full(len(some), pad, np.int32)
            few = pa.table([(some % langs).astype(np.int32), (some // langs).astype(np.int32), ended, ended, ended, alone[some].astype(np.int64)], names=[*names, "n"])
            at = np.flatnonzero(tied)
            lead = [place[at], place[at + 1], np.where(third[at], place[at + 2], pad).astype(np.int32), np.where(fourth[at], place[at + 3], pad).astype(np.int32)]
            many = pa.table([c.lang[at], *lead], names=names).group_by(names, use_threads=False).aggregate([([], "count_all")]).rename_columns([*names, "n"])
            met = pa.concat_tables([few, many]).combine_chunks()
            words = pa.concat_arrays([said, pa.array([""])])
            columns = [pa.array(c.langs, pa.string()).take(met["lang"].combine_chunks()), *[words.take(met[x].combine_chunks()) for x in names[1:]]]
            yield from pa.table([*columns, met["n"]], names=[*names, "n"]).to_batches(max_chunksize=20_000)

    return read.mapInArrow(count, "lang string, w0 string, w1 string, w2 string, w3 string, n long")


def counts(docs: DataFrame, least: int = LEAST, bits: int = BITS) -> DataFrame:
    """lang, words (array; empty: all words of the language) and f of every phrase of one to four words met ``least`` times or more."""
    w = [f"w{i}" for i in range(ORDER)]
    # windows are added up whole before the rollup makes rows of their prefixes: else each task hands on every prefix of every
    # window it meets. One string is shuffled for four; words hold no space, and what ends a window is at its end
    said = windows(docs, least, bits).select("lang", F.rtrim(F.concat_ws(" ", *w)).alias("said"), "n").groupBy("lang", "said").agg(F.sum("n").alias("n"))
    words = F.split("said", " ")
    whole = said.select("lang", *[F.coalesce(F.get(words, F.lit(i)), F.lit("")).alias(x) for i, x in enumerate(w)], "n")
    summed = whole.rollup("lang", *w).agg(F.sum("n").alias("f"), F.grouping_id().alias("g"))
    # a row that ends in the mark of an ended window is no phrase; told by grouping columns alone, so that such rows are not made
    phrase = F.lit(False)
    for i in range(ORDER):
        phrase |= (F.col("g") == (1 << (ORDER - 1 - i)) - 1) & (F.col(w[i]) != "")
    told = summed.where((F.col("g") == (1 << ORDER) - 1) | phrase)
    length = ORDER - F.bit_count("g")
    return told.select("lang", F.slice(F.array(*w), 1, length).alias("words"), "f").where((F.size("words") == 0) | (F.col("f") >= least))


def _wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: each language's first ``top`` phrases."""
    known = written(counts(docs, least, bits).select("lang", F.array_join("words", " ").alias("phrase"), F.size("words").alias("m"), "f"), "phrase-counts")
    totals = known.where("m = 0").select("lang", F.col("f").alias("n"))
    phrases = known.where("m > 0").select("lang", "phrase", "m", "f")
    candidates = phrases.where("m > 1").select("lang", "phrase", "m", F.col("f").alias("a"))
    # a row for each part of each cut; both parts of a cut meet again by phrase
    cut = candidates.withColumn("w", F.split("phrase", " ")).select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    said = lambda first, n: F.array_join(F.expr(f"slice(w, {first}, {n})"), " ")
    sides = F.array(F.struct(F.lit(True).alias("first"), said("1", "k").alias("part")), F.struct(F.lit(False).alias("first"), said("k + 1", "size(w) - k").alias("part")))
    parts = cut.select("lang", "phrase", "a", "k", F.explode(sides).alias("s")).select("lang", "phrase", "a", "k", "s.first", "s.part")
    met = parts.join(phrases.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    score = F.expr("cast(2000000 as decimal(38,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    side = lambda first: F.max(F.when(F.col("first") == first, F.col("f")))
    # dealt once, for both groupings and the join after them
    scored = met.repartition("lang", "phrase").groupBy("lang", "phrase", "a", "k").agg(side(True).alias("l"), side(False).alias("r")).withColumn("score", score)
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    # each phrase's parts of two words or more, with the largest count of a longer one
    inner = candidates.where("m > 2").withColumn("w", F.split("phrase", " "))
    inner = inner.select("lang", "a", F.explode(F.expr(f"flatten(transform(sequence(2, {ORDER - 1}), n -> if(n < m, transform(sequence(1, m - n + 1), i -> array_join(slice(w, i, n), ' ')), array())))")).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("inside"))
    left = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("inside").isNull() | (_wide(F.col("inside")) * 100 < _wide(F.col("a")) * 80))
    ranked = left.select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    some = ranked.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS))).withColumn("i", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("i") <= top)
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9), 'abcdefghijklmnopqrstuvwxyz ') AS text FROM documents),
pieces AS (SELECT d, lang, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (SELECT d, lang, regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]') AS p FROM docs)),
words AS (SELECT d, lang, i, unnest(w) AS w0, generate_subscripts(w, 1) AS place FROM (SELECT d, lang, i, list_filter(string_split(piece, ' '), lambda x: x <> '') AS w FROM pieces)),
lead4 AS MATERIALIZED (SELECT lang, w0, lead(w0, 1) OVER p AS w1, lead(w0, 2) OVER p AS w2, lead(w0, 3) OVER p AS w3 FROM words WINDOW p AS (PARTITION BY d, i ORDER BY place)),
known AS MATERIALIZED (SELECT lang, [w0] AS words, count(*) AS f FROM lead4 GROUP BY ALL
  UNION ALL SELECT lang, [w0, w1], count(*) FROM lead4 WHERE w1 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, [w0, w1, w2], count(*) FROM lead4 WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, [w0, w1, w2, w3], count(*) FROM lead4 WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, count(*) AS n FROM lead4 GROUP BY lang),
candidates AS MATERIALIZED (SELECT lang, words, f AS a FROM known WHERE len(words) > 1 AND f >= 30),
cuts AS MATERIALIZED (SELECT lang, words, a, k, words[1:k] AS x, words[k + 1:] AS y FROM (SELECT lang, words, a, unnest(generate_series(1, len(words) - 1)) AS k FROM candidates)),
lefts AS MATERIALIZED (SELECT c.*, p.f AS l FROM cuts c JOIN known p ON p.lang = c.lang AND p.words = c.x),
scored AS (SELECT c.lang, c.words, c.a, c.k, c.l, p.f AS r, (2000000::HUGEINT * c.a) // (c.l + p.f) AS score FROM lefts c JOIN known p ON p.lang = c.lang AND p.words = c.y),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
inner_parts AS (SELECT lang, a, words[i:i + m - 1] AS words FROM (SELECT lang, a, words, m, unnest(generate_series(1, len(words) - m + 1)) AS i FROM (SELECT lang, a, words, unnest(generate_series(2, len(words) - 1)) AS m FROM candidates WHERE len(words) > 2))),
longer AS (SELECT lang, words, max(a) AS inside FROM inner_parts GROUP BY ALL),
ranked AS (SELECT s.lang, array_to_string(s.words, ' ') AS phrase, s.a, s.l, s.r, s.score::BIGINT AS score FROM lowest s LEFT JOIN longer g ON g.lang = s.lang AND g.words = s.words WHERE g.inside IS NULL OR 100::HUGEINT * g.inside < 80::HUGEINT * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM ranked JOIN totals USING (lang) QUALIFY rank <= 2000
"""
