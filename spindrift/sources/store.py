"""A versioned table store: keyed upserts and scoped deletes that rewrite only the files they touch.

**Layout.** Rows lie in Parquet files, each of one namespace and one bucket (by the hash of the key, so that a namespace of any size is spread).
A manifest names the files of a version with their rows, and the least and largest value of the scope column in each;
it holds no rows, and grows with the number of files alone. Files and manifests are never changed: a new version is new files for the
buckets that were touched, the old names of all others, and a manifest that appears in one step under the next number. A
reader holds a version's files whatever is written meanwhile.

**Upserts.** Of the rows of one key in a namespace the largest version stays. A batch has a name; a name that was applied before changes nothing,
so a repeated micro-batch is safe. Touched buckets are read, merged and written by Spark; a batch never meets other files.

**Deletes.** Files whose range can't hold the value are passed over; in the others only the scope column is read, with the
condition pushed to Parquet's Bloom filters, to count its rows by file; files that hold none keep their names.

**Two writers.** The manifest's number is taken by a rename that fails where the name exists; the loser starts again from the new version,
``TRIES`` times. Files of a version that never appeared are removed by ``vacuum``, as are those of versions it doesn't keep.

A null namespace is a namespace of its own, as is the empty one; null keys equal each other; a null scope value belongs to no one. Of rows equal in key and version
the one with the largest remaining values stays, so a result doesn't depend on the order of rows. An empty batch adds a version without files of its own.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

TRIES = 4
#: Columns that the store adds to files.
SPACE, BUCKET = "_space", "_bucket"


class Conflict(RuntimeError):
    """Other writers took every version this one tried."""


@dataclass(frozen=True)
class Entry:
    """A file of a version."""

    path: str
    space: str
    bucket: int
    rows: int
    least: object
    most: object


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- manifests

    @classmethod
    def create(cls, spark: SparkSession, root: str, schema: StructType, keys: list[str], version: str, namespace: str | None = None, scope: str | None = None, buckets: int = 16) -> Store:
        """An empty store at version 0. ``namespace`` and ``scope`` name columns; a store without a namespace has one space."""
        own = cls(spark, root)
        head = {"schema": schema.jsonValue(), "keys": keys, "version": version, "namespace": namespace, "scope": scope, "buckets": buckets}
        if not own._publish(0, {"head": head, "applied": [], "files": []}):
            raise FileExistsError(f"{root} is a store")
        return own

    def _name(self, number: int) -> str:
        return f"{self.root}/manifests/{number:012d}.json"

    def _publish(self, number: int, manifest: dict) -> bool:
        """Makes ``manifest`` the version ``number`` in one step; False: there is one already."""
        part = self._path(f"{self.root}/manifests/_{uuid.uuid4().hex}")
        out = self._fs.create(part)
        out.write(json.dumps(manifest).encode())
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(part, self._path(self._name(number)), none)
        except Exception as e:
            self._fs.delete(part, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def latest(self) -> int:
        found = [x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return max(int(x[:-5]) for x in found if x.endswith(".json") and not x.startswith("_"))

    def _manifest(self, number: int | None = None) -> tuple[int, dict]:
        number = self.latest() if number is None else number
        stream = self._fs.open(self._path(self._name(number)))
        said = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return number, json.loads(said)

    def files(self, number: int | None = None) -> list[Entry]:
        return [Entry(*x) for x in self._manifest(number)[1]["files"]]

    # ---- rows

    def _stored(self, head: dict) -> StructType:
        return StructType.fromJson(head["schema"]).add(SPACE, StringType()).add(BUCKET, IntegerType())

    def _rows(self, head: dict, files: list[Entry]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self._stored(head))
        return self.spark.read.schema(self._stored(head)).parquet(*[f"{self.root}/{f.path}" for f in files])

    def read(self, number: int | None = None, namespaces: list[str | None] | None = None) -> DataFrame:
        """The rows of a version (of the last, where none is named), of some namespaces alone where they are given."""
        _, m = self._manifest(number)
        files = [Entry(*x) for x in m["files"]]
        if namespaces is not None:
            wanted = {_space_name(x) for x in namespaces}
            files = [f for f in files if f.space in wanted]
        return self._rows(m["head"], files).drop(SPACE, BUCKET)

    def _placed(self, head: dict, df: DataFrame) -> DataFrame:
        """``df`` in the store's columns, with the place of each row."""
        named = [F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromJson(head["schema"])]
        space = _space(F.col(head["namespace"])) if head["namespace"] else F.lit("all")
        return df.select(*named).withColumn(SPACE, space).withColumn(BUCKET, F.pmod(F.xxhash64(*head["keys"]), F.lit(head["buckets"])).cast("int"))

    def _write(self, head: dict, df: DataFrame) -> list[Entry]:
        """Writes one file for each place in ``df``, and reads from them what the manifest says of each."""
        folder = f"data/{uuid.uuid4().hex}"
        options = {f"parquet.bloom.filter.enabled#{head['scope']}": "true"} if head["scope"] else {}
        df.repartition(SPACE, BUCKET).sortWithinPartitions(SPACE, BUCKET, *head["keys"]).select("*", F.md5(SPACE).alias("s"), F.col(BUCKET).alias("b")).write.options(**options).partitionBy("s", "b").parquet(f"{self.root}/{folder}")
        there = self.spark.read.schema(self._stored(head)).option("recursiveFileLookup", True).parquet(f"{self.root}/{folder}")
        scope = F.col(head["scope"]) if head["scope"] else F.lit(None).cast("string")
        each = there.select("*", F.col("_metadata.file_path").alias("file")).groupBy("file", SPACE, BUCKET).agg(F.count("*").alias("n"), F.min(scope).alias("lo"), F.max(scope).alias("hi"))
        return [Entry(r["file"][r["file"].index(folder) :], r[SPACE], r[BUCKET], r["n"], _plain(r["lo"]), _plain(r["hi"])) for r in each.collect()]  # one row for each file

    def upsert(self, batch: DataFrame, name: str) -> int:
        """Applies a batch and returns the version that holds it."""
        for _ in range(TRIES):
            number, m = self._manifest()
            if name in m["applied"]:
                return number
            head, files = m["head"], [Entry(*x) for x in m["files"]]
            new = self._placed(head, batch)
            touched = {(r[0], r[1]) for r in new.select(SPACE, BUCKET).distinct().collect()}  # buckets times namespaces at most
            old = [f for f in files if (f.space, f.bucket) in touched]
            merged = self._rows(head, old).unionByName(new)
            columns = [f.name for f in StructType.fromJson(head["schema"])]
            order = F.struct(head["version"], *[c for c in columns if c != head["version"]])
            last = merged.groupBy(SPACE, BUCKET, *[F.col(k).alias(f"_k{i}") for i, k in enumerate(head["keys"])]).agg(F.max(order).alias("row"))
            made = self._write(head, last.select(*[F.col("row")[c].alias(c) for c in columns], SPACE, BUCKET)) if touched else []
            if self._publish(number + 1, m | {"applied": [*m["applied"], name], "files": [f for f in m["files"] if (f[1], f[2]) not in touched] + [_as_list(f) for f in made]}):
                return number + 1
        raise Conflict(f"{self.root}: other writers were faster {TRIES} times")

    def delete(self, value: object) -> dict:
        """Removes the rows whose scope column equals ``value``; says how many there were, went and remain, and which files changed."""
        for _ in range(TRIES):
            number, m = self._manifest()
            head, files = m["head"], [Entry(*x) for x in m["files"]]
            if not head["scope"]:
                raise ValueError("the store has no scope column")
            may = [f for f in files if f.least is not None and f.least <= value <= f.most]
            own = F.col(head["scope"]) == F.lit(value)
            held = self._rows(head, may).where(own).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n")).collect() if may else []
            name = lambda path: path[path.rindex("data/") :]
            counts = {name(r["file"]): r["n"] for r in held}
            hit = [f for f in may if f.path in counts]
            report = {"inserted": sum(counts.values()), "scanned_files": len(may), "rewritten_files": len(hit), "kept_files": len(files) - len(hit)}
            if not hit:
                return report | {"version": number, "deleted": 0, "remaining": 0, "completed": True}
            made = self._write(head, self._rows(head, hit).where(~own | F.col(head["scope"]).isNull()))
            gone = {f.path for f in hit}
            if self._publish(number + 1, m | {"files": [f for f in m["files"] if f[0] not in gone] + [_as_list(f) for f in made]}):
                deleted = sum(f.rows for f in hit) - sum(f.rows for f in made)
                left = self._rows(head, [f for f in self.files(number + 1) if f.least is not None and f.least <= value <= f.most]).where(own).count()
                return report | {"version": number + 1, "deleted": deleted, "remaining": left, "completed": left == 0}
        raise Conflict(f"{self.root}: other writers were faster {TRIES} times")

    def vacuum(self, keep: int = 1) -> int:
        """Removes all but the last ``keep`` versions and the files that none of those names; returns how many files went. Not to be run beside writers."""
        last = self.latest()
        first = max(0, last - keep + 1)
        names = {f.path for n in range(first, last + 1) for f in self.files(n)}
        gone = 0
        walk = self._fs.listFiles(self._path(f"{self.root}/data"), True) if self._fs.exists(self._path(f"{self.root}/data")) else None
        while walk is not None and walk.hasNext():
            path = walk.next().getPath()
            said = path.toString()
            if said.endswith(".parquet") and said[said.rindex("data/") :] not in names:
                gone += bool(self._fs.delete(path, False))
        for n in range(first):
            self._fs.delete(self._path(self._name(n)), False)
        return gone


def _space(c: Column) -> Column:
    return F.when(c.isNull(), "null").otherwise(F.concat(F.lit("n:"), c.cast("string")))


def _space_name(x: str | None) -> str:
    return "null" if x is None else f"n:{x}"


def _plain(x: object) -> object:
    return x if x is None or isinstance(x, (int, float, str)) else str(x)


def _as_list(f: Entry) -> list:
    return [f.path, f.space, f.bucket, f.rows, f.least, f.most]
