"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees.

The trees are fitted on a bounded sample (``SAMPLE`` rows, by hash of the id); every row is then
put into one leaf of each tree. Inner products become angles by one more coordinate,
sqrt(longest ** 2 - length ** 2), which queries have as zero. A query walks all trees through one shared priority
queue, ordered by the sum of the squared margins that were crossed on the way, and takes the best ``max(trees, leaves / PART)``
leaves, with 8 trees the inner products of four fifths of a table.
Queries meet rows by subtree (``GROUP`` rows or so; larger ones, as of copies of one vector,
are split; queries come in blocks of ``ASKED``, so that no group grows with them), each subtree returns a query's best k as one row, and scores are exact: computed in double
precision on the original vectors, pair by pair in one order of addition. Ties go to the smaller id.

The trees go to the tasks, and have a bound: at most ``SAMPLE / 4`` inner nodes each and ``FOREST`` bytes in all. Vectors without
structure (random directions) need a share of all leaves for a given recall, which is why the number of leaves grows with
the rows; tests measure recall against brute force at these settings.

Vectors that are null, zero, of another length than most of the sample, or with null or non-finite components take no part,
as rows or as queries. Null ids take no part. Rows that repeat an id and vector count once in a query's list.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.llm.common import table, written

K = 20
SAMPLE = 65_536
TREES = 8
LEAF = 64
PART = 10
FOREST = 64 << 20
GROUP = 8_192
#: Queries that meet a subtree in one place: eight times its rows, so that rows repeated for each block are the smaller part of what is shuffled.
ASKED = 65_536
#: Inner products that are held at once.
HELD = 1 << 22
EVERY = 20


class Forest:
    """Hyperplanes of all trees; a node's children are 2 * node + 1 and 2 * node + 2."""

    def __init__(self, sample, depth: int, trees: int = TREES, seed: int = 8) -> None:
        import numpy as np

        rng = np.random.default_rng(seed)
        n, dim = sample.shape
        self.depth, self.trees = depth, trees
        self.normals = np.zeros((trees, 2**depth - 1, dim))
        self.cuts = np.zeros((trees, 2**depth - 1))
        for t in range(trees):
            todo = [(0, np.arange(n))]
            while todo:
                node, rows = todo.pop()
                if node >= 2**depth - 1:
                    continue
                w = np.zeros(dim)
                if len(rows) > 1:
                    a, b = rng.choice(rows, 2, replace=False)
                    w = sample[a] - sample[b]
                if not w.any():
                    w = rng.normal(size=dim)
                w /= np.linalg.norm(w)
                at = sample[rows] @ w
                cut = float(np.median(at)) if len(rows) else 0.0
                self.normals[t, node], self.cuts[t, node] = w, cut
                todo += [(2 * node + 1, rows[at <= cut]), (2 * node + 2, rows[at > cut])]

    def leaves(self, x):
        """Leaf of each row of ``x`` in each tree."""
        import numpy as np

        out = np.zeros((len(x), self.trees), np.int64)
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", x, self.normals[t, node]) > self.cuts[t, node]
                node = 2 * node + 1 + side
            out[:, t] = node - (2**self.depth - 1)
        return out

    def search(self, q, most: int) -> list[tuple[int, int]]:
        """The ``most`` best leaves (tree, leaf) for a query."""
        inner = 2**self.depth - 1
        margins = (self.normals @ q - self.cuts).tolist()
        queue = [(0.0, t, 0) for t in range(self.trees)]
        found: list[tuple[int, int]] = []
        while queue and len(found) < most:
            crossed, t, node = heapq.heappop(queue)
            own = margins[t]
            while node < inner:  # down the near side, leaving the far side in the queue
                margin = own[node]
                near, far = (2 * node + 2, 2 * node + 1) if margin > 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (crossed + margin * margin, t, far))
                node = near
            found.append((t, node - inner))
        return found


def _matrix(column: pa.Array):
    import numpy as np

    return np.array(column.to_pylist(), np.float64)


def _usable(vectors: DataFrame, dim: int | None) -> DataFrame:
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.where("vec_id is not null and embedding is not null").where(fine)
    return rows.where(F.size(e) == dim) if dim is not None else rows


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, sample: int = SAMPLE, trees: int = TREES, leaf: int = LEAF, part: int = PART, asked_at_once: int = ASKED) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row whose id is divisible by ``every``."""
    import numpy as np

    spark = vectors.sparkSession
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    dims = _usable(base, None).groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.max(squares).alias("longest"), F.count_if(F.col("vec_id") % every == 0).alias("asked")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n, longest = dims[0]["dim"], dims[0]["n"], float(dims[0]["longest"])
    blocks = max(1, -(-dims[0]["asked"] // asked_at_once))
    longest = longest if np.isfinite(longest) else 0.0  # lengths whose squares are no doubles: directions alone decide where to look
    rows = _usable(base, dim)
    share = min(1.0, 0.9 * sample / n)
    picked = rows.where((F.pmod(F.xxhash64("vec_id", F.lit(8)), F.lit(1_000_000)) < int(1_000_000 * share)) | F.lit(n <= sample)).select("embedding").limit(sample).collect()
    fitted = np.array([r[0] for r in picked], np.float64).reshape(-1, dim)

    def longer(x):
        return np.column_stack([x, np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))])

    depth = max(1, int(np.ceil(np.log2(max(1, n / leaf)))))
    depth = min(depth, max(1, int(np.log2(max(2, len(fitted) / 4)))))
    depth = min(depth, max(1, int(np.log2(FOREST / (8 * trees * (dim + 2))))))
    forest = spark.sparkContext.broadcast(Forest(longer(fitted) if len(fitted) else np.zeros((0, dim + 1)), depth, trees))
    most = max(trees, (trees << depth) // part)
    down = max(0, depth - max(0, int(np.log2(max(1, n / GROUP)))))  # levels of a subtree that is searched in one place

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = forest.value.leaves(longer(_matrix(b.column(1)))) if b.num_rows else np.zeros((0, trees), np.int64)
            rep = np.repeat(np.arange(b.num_rows), trees)
            tree = np.tile(np.arange(trees), b.num_rows)
            flat = at.reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(flat >> down), pa.array(flat), b.column(0).take(pa.array(rep)), b.column(1).take(pa.array(rep))], ["tree", "sub", "leaf", "vec_id", "embedding"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for vec_id, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by: dict[tuple[int, int], list[int]] = {}
                for t, x in forest.value.search(np.array([*e, 0.0]), most):
                    by.setdefault((t, x >> down), []).append(x)
                out += [(t, s, vec_id, e, x) for (t, s), x in by.items()]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], ty) for c, ty in enumerate(types)], ["tree", "sub", "query_id", "q", "leaves"])

    index = written(rows.mapInArrow(place, "tree long, sub long, leaf long, vec_id long, embedding array<double>"), "forest-index")
    sizes = index.groupBy("tree", "sub").agg(F.ceil(F.count("*") / (4 * GROUP)).cast("int").alias("parts"))
    asked = rows.where(F.col("vec_id") % every == 0).mapInArrow(probe, "tree long, sub long, query_id long, q array<double>, leaves array<long>")
    members = index.join(sizes, ["tree", "sub"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")
    members = members.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))) if blocks > 1 else F.lit(0))
    probes = asked.join(sizes, ["tree", "sub"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts").withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(blocks)).cast("int"))

    def meet(own: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("found", pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())])))])
        if not own.num_rows or not queries.num_rows:
            return schema.empty_table()
        ids, leaf_of, x = own["vec_id"].to_numpy(), own["leaf"].to_numpy(), _matrix(own["embedding"])
        order = np.argsort(leaf_of, kind="stable")
        ids, leaf_of, x = ids[order], leaf_of[order], x[order]
        names, q = queries["query_id"].to_numpy(), _matrix(queries["q"])
        # beyond the rounding of a matrix product: equal scores stay equal candidates
        slack = 1e-12 * np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1).max()
        visits: dict[int, list[int]] = {}
        for i, leaves in enumerate(queries["leaves"].to_pylist()):
            for v in leaves:
                visits.setdefault(v, []).append(i)
        got: list[tuple] = []
        for v, visitors in visits.items():
            lo, hi = np.searchsorted(leaf_of, [v, v + 1])
            if lo == hi:
                continue
            step = max(1, HELD // int(hi - lo))
            for some in range(0, len(visitors), step):
                who = np.array(visitors[some : some + step])
                near = q[who] @ x[lo:hi].T
                near[names[who][:, None] == ids[lo:hi][None, :]] = -np.inf
                if hi - lo > k:
                    kth = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
                    i, j = np.nonzero((near >= kth - slack[who]) & (near > -np.inf))
                else:
                    i, j = np.nonzero(near > -np.inf)
                exact = np.multiply(q[who[i]], x[lo + j]).sum(axis=1)
                got.append((who[i], ids[lo + j], exact))
        if not got:
            return schema.empty_table()
        who, vec, score = (np.concatenate(c) for c in zip(*got, strict=True))
        by = np.lexsort((vec, -score, who))
        who, vec, score = who[by], vec[by], score[by]
        once = np.ones(len(who), bool)
        once[1:] = (who[1:] != who[:-1]) | (vec[1:] != vec[:-1])
        who, vec, score = who[once], vec[once], score[once]
        first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
        ends = np.concatenate((first[1:], [len(who)]))
        lists = [[{"score": s, "vec_id": d} for s, d in zip(score[a : min(a + k, b)].tolist(), vec[a : min(a + k, b)].tolist(), strict=True)] for a, b in zip(first, ends, strict=True)]
        return pa.Table.from_arrays([pa.array(names[who[first]], pa.int64()), pa.array(lists, schema.field("found").type)], schema=schema)

    keys = ["tree", "sub", "part", "block"]
    pairs = members.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInArrow(meet, "query_id long, found array<struct<score:double,vec_id:long>>")
    near = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("found", lambda x: F.struct((-x["score"]).alias("less"), x["vec_id"].alias("vec_id")))))))
    best = pairs.groupBy("query_id").agg(F.slice(near, 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "hit")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.less")).alias("score"))


def exact_nearest(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """The same by brute force in SQL, for measuring recall on small tables."""
    base = _usable(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")), None)
    q = base.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    score = F.aggregate(F.zip_with("q", "embedding", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    pairs = q.join(base, F.col("query_id") != F.col("vec_id")).select("query_id", "vec_id", score.alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
