"""SimHash near-duplicates through pivot distance tables.

A document's fingerprint is the bitwise majority of its shingles' hashes. Equal fingerprints
are one node. Every node gets its Hamming distances to a table of reference fingerprints
(pivots), packed one byte each into longs. Two nodes within ``RADIUS`` bits differ by at most
``RADIUS`` in every coordinate, so a pair whose largest coordinate difference is greater is
discarded, and the rest are verified on the fingerprints themselves.

Which nodes meet at all is not dealt by pivots, as about half of all pairs lie within three bits of each
other in the distance to a random one: of five blocks, nodes within three bits agree on two whole blocks at least (three bits
spoil three blocks at most), so the nodes are dealt by the contents of each of the ten pairs of blocks. That is
lossless and keeps groups small (25 bits or more of key); no pair meets outside a group. Only the
first group in which a pair meets keeps it.

Links become components by rounds of hooking to the smallest neighbour and pointer jumping, each
written to the shared folder; only nodes with links take part.

``near_dedup`` (the pipeline's stage) does not use the fingerprints: it compares sets of five-word shingles.

No words (null, empty, white space): fingerprint zero, linked like any other. Repeated rows and ids
stay separate rows of one component; a null doc_id is ignored where the smallest is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from spindrift.llm.common import SPACE_RUN, passing, table, written

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Words in a shingle of ``near_dedup``, and the counters (a power of two) that tell its order which shingles are frequent.
WORDS = 5
COUNTERS = 16
#: Texts of a shingle that all its others are compared with first.
CENTRES = 8
#: Longs of the bits that bound how many shingles two sets don't share.
SIGNS = 8
#: Bits of a bitmap of ids asked for, as a power of two, at most.
ASKED_BITS = 27
#: What stands before a word sequence in its second digest: no word holds it.
BEFORE = "\n"
#: Bytes of text that are hashed together.
CHUNK = 4 << 20
#: Widths of the five blocks, from the lowest bit.
BLOCKS = [13, 13, 13, 13, 12]
#: Reference fingerprints: fixed values, sixteen words of the golden-ratio sequence.
PIVOTS = [((i + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1) for i in range(16)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """Majority of the bits of the shingles' XXH64 hashes; a bit needs over half of them."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    if len(words) < n:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    h, digest = [], xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = [digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)]
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        part = np.array(h[i : i + 8192], "<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [_signed(fingerprint(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _tables(fp: Column) -> list[Column]:
    """Distances to the pivots, eight to a long."""
    out = []
    for i in range(0, len(PIVOTS), 8):
        word = F.lit(0).cast("long")
        for j, p in enumerate(PIVOTS[i : i + 8]):
            word = word.bitwiseOR(F.shiftleft(_distance(fp, F.lit(_signed(p))).cast("long"), 8 * j))
        out.append(word)
    return out


def _block(fp: Column, b: int) -> Column:
    return F.shiftrightunsigned(fp, sum(BLOCKS[:b])).bitwiseAND(F.lit((1 << BLOCKS[b]) - 1))


def links(nodes: DataFrame) -> DataFrame:
    """Pairs a < b of the distinct fingerprints in ``nodes`` (fp) that differ in at most RADIUS bits."""
    pairs = list(combinations(range(len(BLOCKS)), 2))
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.shiftleft(_block(F.col("fp"), a), 13).bitwiseOR(_block(F.col("fp"), b)).alias("key")) for k, (a, b) in enumerate(pairs)])
    t = _tables(F.col("fp"))
    dealt = nodes.select("fp", *[c.alias(f"t{i}") for i, c in enumerate(t)], F.explode(keys).alias("g")).select("fp", *[f"t{i}" for i in range(len(t))], "g.k", "g.key")
    x, y = dealt.alias("x"), dealt.alias("y")
    at = lambda s, i, j: F.shiftright(F.col(f"{s}.t{i}"), 8 * j).bitwiseAND(F.lit(127))
    apart = F.greatest(*[F.abs(at("x", i, j) - at("y", i, j)) for i in range(len(t)) for j in range(8)])
    fx, fy = F.col("x.fp"), F.col("y.fp")
    first = F.lit(True)  # no group before this one holds the pair
    for k, (a, b) in enumerate(pairs):
        same = (_block(fx, a) == _block(fy, a)) & (_block(fx, b) == _block(fy, b))
        first &= ~((F.col("x.k") > k) & same)
    met = (F.col("x.k") == F.col("y.k")) & (F.col("x.key") == F.col("y.key")) & (fx < fy)
    return x.join(y, met & (apart <= RADIUS) & (_distance(fx, fy) <= RADIUS) & first).select(fx.alias("a"), fy.alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of every node of ``edges`` (a, b)."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    roots = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        # the root of a node learns of the smallest root near any of its nodes, and then all jump to the root of their root
        met = roots.join(near, "node").select("node", "root", F.least("root", "r").alias("r"))
        told = met.select(F.col("root").alias("of"), "r").union(met.select(F.col("node").alias("of"), "r")).groupBy("of").agg(F.min("r").alias("r"))
        hooked = written(roots.join(told, roots["node"] == told["of"], "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("r", "root")).alias("root")), "hooked")
        jump = hooked.select(F.col("node").alias("root"), F.col("root").alias("up"))
        after = written(hooked.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("up", "root")).alias("root")), "roots")
        if after.where("root <> old").limit(1).count() == 0:
            return after.select("node", "root")
        roots = after.select("node", "root")


def clusters(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable) of every row of ``docs``."""
    prints = written(fingerprints(docs), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    roots = components(links(nodes))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def _mix(a, b):
    import numpy as np

    x = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


def _shingled(texts: pa.Array) -> Iterator[tuple[int, int, object]]:
    """For each text: both digests of its word sequence (as ``_said``) and the sorted hashes of its different shingles; of fewer words the sequence is one.

    A chunk's words are numbered by Arrow, each different one is hashed once, and windows of hashes are mixed with numpy.
    """
    import numpy as np
    import pyarrow.compute as pc
    import xxhash

    def digests(of: pa.Array, before: bytes = b""):
        return np.fromiter((xxhash.xxh64_intdigest(before + x, SEED) for x in of.cast(pa.binary()).to_pylist()), np.uint64, len(of))

    texts = pc.fill_null(texts, "")
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + CHUNK, "right")))
        lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts.slice(lo, hi - lo))))
        line = pc.binary_join(lists, " ")
        said, also = digests(line), digests(line, BEFORE.encode()).view(np.int64).tolist()
        named = pc.list_flatten(lists).dictionary_encode()
        h = digests(named.dictionary)[named.indices.to_numpy()]
        w = h
        for j in range(1, WORDS):
            h = _mix(h[: len(w) - j], w[j:])
        many = pc.list_value_length(lists).to_numpy()
        for d, e, at, n in zip(said, also, (np.cumsum(many) - many).tolist(), many.tolist(), strict=True):
            own = np.sort((h[at : at + n - WORDS + 1] if n >= WORDS else d.reshape(1)).view(np.int64))
            new = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=new[1:])
            yield int(d.view(np.int64)), e, own[new]
        lo = hi


def _said(text: Column) -> tuple[Column, Column]:
    """Two digests of the word sequence, 128 bits in all (XXH64 under ``SEED``, which is Spark's own seed, of it and of it after ``BEFORE``)."""
    upper = "".join(map(chr, range(65, 91)))
    words = F.btrim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), SPACE_RUN, " "), F.lit(" "))
    return F.xxhash64(words), F.xxhash64(F.concat(F.lit(BEFORE), words))


def _counts(docs: DataFrame) -> list[int]:
    """How often shingles are met in all documents, by the first ``COUNTERS`` bits of their hashes. They only set an order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        n = np.zeros(1 << COUNTERS, np.int64)
        for b in batches:
            for _, _, h in _shingled(b.column(0)):
                np.add.at(n, h.view(np.uint64) >> np.uint64(64 - COUNTERS), 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["slot", "n"])

    out = [0] * (1 << COUNTERS)
    for r in docs.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # bounded by the counters
        out[r["slot"]] = r["n"]
    return out


def _prefixes(docs: DataFrame) -> DataFrame:
    """node (a number), said and also (digests of the words), doc_id, n (shingles), prefix (the rarest of them, in the order of all) and s0.. (which
    slots hold an odd number of them, a bit for each) of every different text."""
    held = docs.sparkSession.sparkContext.broadcast(_counts(docs))
    names = [f"s{i}" for i in range(SIGNS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        counts = np.array(held.value, np.int64)
        for b in batches:
            said, also, sizes, first, odd = [], [], [], [], []
            for d, e, h in _shingled(b.column(1)):
                said.append(d)
                also.append(e)
                often = counts[h.view(np.uint64) >> np.uint64(64 - COUNTERS)]
                sizes.append(len(h))
                odd.append(np.packbits(np.bincount(h & (64 * SIGNS - 1), minlength=64 * SIGNS) & 1).view(np.int64))
                first.append(h[np.lexsort((h, often))][: len(h) - -(-4 * len(h) // 5) + 1])
            signs = [pa.array(np.ascontiguousarray(x)) for x in np.array(odd, np.int64).reshape(-1, SIGNS).T]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(said, pa.int64()), pa.array(also, pa.int64()), pa.array(sizes, pa.int32()), pa.array(first, pa.list_(pa.int64())), *signs], ["doc_id", "said", "also", "n", "prefix", *names])

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, said long, also long, n int, prefix array<long>" + "".join(f", {x} long" for x in names))
    different = rows.groupBy("said", "also").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), *[F.first(x).alias(x) for x in names])
    # numbers hold from here on, as the table is written; which text gets which decides nothing
    return written(different.withColumn("node", F.monotonically_increasing_id()), "prefixes")


def _parities(h) -> bytes:
    """Which slots hold an odd number of the hashes ``h``, a bit for each: twice as many slots as hashes or more, a power of two."""
    import numpy as np

    slots = max(64, 1 << (2 * len(h) - 1).bit_length())
    return (np.packbits(np.bincount(h & (slots - 1), minlength=slots) & 1, bitorder="little")).tobytes()


def _unlike(x: bytes, y: bytes) -> int:
    """At least how many hashes only one of two sets has, by their ``_parities``; the longer one is folded to the length of the other."""
    if len(x) > len(y):
        x, y = y, x
    bits = int.from_bytes(x, "little")
    for at in range(0, len(y), len(x)):
        bits ^= int.from_bytes(y[at : at + len(x)], "little")
    return bits.bit_count()


def _close(rows: DataFrame) -> DataFrame:
    """a, b, an and bn of those pairs whose parities (p, q) allow it: sets alike to 0.8 have at most a ninth of both sizes of hashes that only one has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            an, bn, p, q = (b.column(i).to_pylist() for i in range(2, 6))
            near = [9 * _unlike(x, y) <= n + m for n, m, x, y in zip(an, bn, p, q, strict=True)]
            yield pa.RecordBatch.from_arrays(b.columns[:4], ["a", "b", "an", "bn"]).filter(pa.array(near, pa.bool_()))

    return rows.select("a", "b", "an", "bn", "p", "q").mapInArrow(run, "a long, b long, an int, bn int")


def _drawn(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, name: str, whole: bool) -> DataFrame:
    """node and ``value`` of every node of ``pairs``: its sorted set of shingles, if ``whole``, else the parities of it.

    Texts are not shuffled: a bitmap of what is asked for, by hashes of ids, tells each task which of its own texts to cut.
    Rows that it lets through by chance are dropped by the join, as are those that share an id, or have none, but not the words.
    """
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    named = written(asked.join(nodes.select("node", "doc_id", "said", "also"), "node"), f"{name}-named")
    bits = min(ASKED_BITS, max(16, (16 * named.count()).bit_length()))
    slot = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - bits)
    held = docs.sparkSession.sparkContext.broadcast(_asked(named.select((slot + 1).alias("at")), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        bitmap = np.frombuffer(held.value, np.uint8)
        for b in batches:
            at = b.column(2).to_numpy()
            b = b.filter(pa.array((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            own = list(_shingled(b.column(1)))
            said, also = (pa.array([x[i] for x in own], pa.int64()) for i in range(2))
            value = pa.array([h for _, _, h in own], pa.list_(pa.int64())) if whole else pa.array([_parities(h) for _, _, h in own], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), said, also, value], ["doc_id", "said", "also", "value"])

    kind = "array<long>" if whole else "binary"
    cut = docs.select("doc_id", "text", slot.alias("at")).mapInArrow(run, f"doc_id long, said long, also long, value {kind}")
    # dealt once, for the copies and for the join
    keys = ["doc_id", "said", "also"]
    x, y = cut.dropDuplicates(keys).alias("x"), named.hint("merge").alias("y")
    same = F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.said") == F.col("y.said")) & (F.col("x.also") == F.col("y.also"))
    return written(x.join(y, same).select("y.node", "x.value"), f"{name}-values")


def _asked(slots: DataFrame, bits: int) -> bytes:
    """A bitmap of 2^bits bits in which those of ``slots`` (at, from one) are set."""
    import numpy as np

    blocks = slots.groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(1 << bits >> 3, np.uint8)
    for r in blocks.collect():  # bounded by the bits
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def _verified(met: DataFrame, nodes: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b, an, bn) of ``met`` that are alike on whole shingle sets."""
    side = lambda of, node, value: of.select(F.col("node").alias(node), F.col("value").alias(value))
    with passing(docs.sparkSession):
        pairs = written(met.dropDuplicates(["a", "b"]), f"{name}-met")
        # whole sets are made, and travel, for pairs that their parities, a thirtieth of a set, do not tell apart
        odd = _drawn(pairs, nodes, docs, f"{name}-odd", whole=False)
        close = written(_close(pairs.join(side(odd, "a", "p"), "a").join(side(odd, "b", "q"), "b")), f"{name}-close")
        sets = _drawn(close, nodes, docs, f"{name}-sets", whole=True)
        both = close.join(side(sets, "a", "x"), "a").join(side(sets, "b", "y"), "b")
        return written(both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.col("an") + F.col("bn"))).select("a", "b"), name, lasting=True)


def near_groups(docs: DataFrame) -> DataFrame:
    """said and also (digests of a word sequence), doc_id (the smallest that has it; null: none has one) and root (one for each group of near copies)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    nodes = _prefixes(texts)
    each = nodes.select("node", "n", F.posexplode("prefix").alias("i", "h"))
    often = F.count("*").over(Window.partitionBy("h"))
    dealt = written(each.withColumn("often", often).where("often > 1").drop("often"), "prefixes-met")
    # several centres of a shingle, by fixed orders of the texts: where a group is loose, one of them seldom reaches all
    by = [F.xxhash64("node", F.lit(i)) for i in range(CENTRES // 2)]
    ends = [f(F.struct(v.alias("v"), "node", "n", "i")) for v in by for f in (F.min, F.max)]
    shared = dealt.groupBy("h").agg(F.array_distinct(F.transform(F.array(*ends), lambda e: F.struct(e["node"].alias("node"), e["n"].alias("n"), e["i"].alias("i")))).alias("c"))
    centres = shared.select("h", F.explode("c").alias("c"))

    def likely(x: str, y: str) -> Column:
        """Sizes at all alike, and enough shingles left from this one on: the first that two sets share has all others after it."""
        n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
        left = F.least(n - F.col(f"{x}.i"), m - F.col(f"{y}.i"))
        return (5 * n >= 4 * m) & (5 * m >= 4 * n) & (9 * left >= 4 * (n + m))

    # every text meets the centres of each shingle, so that large groups join by stars and not by all pairs
    drawn = dealt.select("h", F.struct("node", "n", "i").alias("t")).join(centres, "h").where((F.col("c.node") != F.col("t.node")) & likely("c", "t"))
    pair = lambda x, y: (F.col(f"{x}.node").alias("a"), F.col(f"{y}.node").alias("b"), F.col(f"{x}.n").alias("an"), F.col(f"{y}.n").alias("bn"))
    star = drawn.select(F.least("c", "t").alias("x"), F.greatest("c", "t").alias("y")).select(*pair("x", "y"))
    linked = _verified(star, nodes, texts, "star-links")
    rooted = dealt.select("node", "n", "i", "h").join(components(linked), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = written(rooted, "star-roots")
    # then texts of one shingle that are still apart meet each other
    apart = rooted.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("h")
    signs = [f"s{i}" for i in range(SIGNS)]
    split = written(rooted.join(apart, "h").join(nodes.select("node", *signs), "node"), "open-shingles")
    # each bit that differs is a shingle at least that only one of the two has, and sets alike to 0.8 have at most a ninth of both sizes of those
    unlike = sum((_distance(F.col(f"x.{s}"), F.col(f"y.{s}")) for s in signs), F.lit(0))
    met = (F.col("x.h") == F.col("y.h")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & likely("x", "y") & (9 * unlike <= F.col("x.n") + F.col("y.n"))
    pairs = split.alias("x").join(split.alias("y"), met).select(*pair("x", "y"))
    rest = _verified(pairs, nodes, texts, "rest-links")
    return nodes.select("node", "doc_id", "said", "also").join(components(linked.union(rest)), "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node")


def near_dedup(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id (then digest), once.

    Near copies have a Jaccard similarity of 0.8 or more over their sets of five-word shingles (of fewer words: the
    sequence); groups are their components. Candidates share one of the rarest shingles: in any one order of all
    shingles, two sets so alike share one among the first n - ceil(0.8 n) + 1, so no pair is lost; frequent
    shingles, by counts over all documents, are put last in the order, and a pair meets only where what
    follows the shared one can still be enough and, beyond the centres, where the parities of the two sets' slots allow it. Every link is verified on the whole sets of shingles' 64-bit hashes. Texts of equal words
    are told by 128 bits of digests. Texts without words are one group. Tables that only lead to the result are removed when it is known.
    Rows that share an id, or have none, are judged each by its words; those with the same words are one document,
    of which the smallest hash of the text stays. A row without an id comes after all that have one.
    """
    with passing(docs.sparkSession):
        best = near_groups(docs).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "said", "also")).alias("k"))
        keep = written(best.select(F.col("k.doc_id").alias("id"), "k.said", "k.also"), "kept", lasting=True)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), "text")
    shared = written(rows.where("id is not null").groupBy("id").count().where("count > 1").select("id"), "shared-ids")
    # an id of one row tells its words; only rows that share theirs, or have none, are told apart by words, and by text
    alone = rows.where("id is not null").join(shared, "id", "left_anti").join(keep, "id", "left_semi")
    first = F.row_number().over(Window.partitionBy("id", "said", "also").orderBy(F.xxhash64("text"), "text"))
    said, also = _said(F.col("text"))
    several = rows.join(shared, "id", "left_semi").withColumns({"said": said, "also": also}).join(keep, ["id", "said", "also"], "left_semi").withColumn("place", first).where("place = 1")
    nameless = rows.where("id is null").withColumns({"said": said, "also": also}).join(keep.where("id is null"), ["said", "also"], "left_semi").withColumn("place", first).where("place = 1")
    return alone.select("row").union(several.select("row")).union(nameless.select("row")).select("row.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
