"""Token ids in files of fixed-width bit packing.

A file holds the ids of consecutive documents in ascending doc_id order, each id in the fewest bits
that the vocabulary needs. Ids are packed in blocks of ``BLOCK`` ids; every block begins at a whole
byte, so block offsets are known from the header and a block is unpacked by itself with numpy.

Layout of a file (little-endian): the magic, bits of an id, ids of a block, documents, ids and
the bytes of all blocks (unsigned 64-bit each); then the document table (doc_id, null flag,
first id); then block offsets in bytes from the first block; then the blocks.

A task writes files of consecutive doc_ids, each of ``FILE`` ids or little more (a document is never split), so neither a
file nor what a task holds grows with the data. Each is written under a name of its own attempt and
then moved to its place, so a task that is run twice leaves whole files. Files go to the shared
folder through ``pyarrow.fs``, which reaches local and remote stores alike, and are read back by
Spark's binary file source. The vocabulary's size is the tokenizer's own; an id beyond it is an error.

A null text is empty: its only id is the end id. Null ids sort first; equal ids follow each other
by text, so repeated rows are written as often as they occur. Other columns are not read. An empty table leaves no files
and an empty result.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.llm.common import encoder, partitions, shared_dir, table, written

MAGIC = b"SPNDRFT1"
BLOCK = 4096
#: Ids after which a file ends.
FILE = 1 << 24
END = 1


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bits_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids, bits: int) -> bytes:
    """``ids`` (unsigned) in ``bits`` bits each, least significant bit first, to a whole byte: 64 ids make ``bits`` words."""
    import numpy as np

    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id of more than {bits} bits")
    n = -(-len(ids) // 64)
    whole = np.zeros(n * 64, np.uint64)
    whole[: len(ids)] = ids
    rows = whole.reshape(n, 64)
    out = np.zeros((n, bits), "<u8")
    for i in range(64):
        word, at = divmod(i * bits, 64)
        out[:, word] |= rows[:, i] << np.uint64(at)
        if at + bits > 64:
            out[:, word + 1] |= rows[:, i] >> np.uint64(64 - at)
    return out.tobytes()[: -(-len(ids) * bits // 8)]


def unpack_bits(data: bytes, n: int, bits: int):
    import numpy as np

    m = -(-n // 64)
    words = np.frombuffer(bytes(data).ljust(8 * m * bits, b"\0"), "<u8", m * bits).reshape(m, bits)
    out, mask = np.empty((m, 64), "<u4"), np.uint64((1 << bits) - 1)
    for i in range(64):
        word, at = divmod(i * bits, 64)
        x = words[:, word] >> np.uint64(at)
        if at + bits > 64:
            x = x | (words[:, word + 1] << np.uint64(64 - at))
        out[:, i] = x & mask
    return out.reshape(-1)[:n]


def to_file(doc_ids: list[int | None], ids: list, vocabulary: int) -> bytes:
    """``ids``: arrays of unsigned ids, one for each document."""
    import numpy as np

    bits = bits_of(vocabulary)
    every = np.concatenate(ids) if ids else np.zeros(0, "<u2")
    if len(every) and int(every.max()) >= vocabulary:
        raise ValueError("an id beyond the vocabulary")
    first = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype("<i8")
    body = pack_bits(every, bits)  # a block is a whole number of words, so all are packed as one
    offsets = np.minimum(np.arange(-(-len(every) // BLOCK) + 1, dtype="<i8") * (BLOCK * bits // 8), len(body))
    names = np.array([d or 0 for d in doc_ids], "<i8")
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    head = MAGIC + struct.pack("<5Q", bits, BLOCK, len(doc_ids), len(every), len(body))
    return b"".join([head, names.tobytes(), nulls.tobytes(), first.tobytes(), offsets.tobytes(), body])


class TokenFile:
    """Random access to a file's documents: only the blocks that hold a document are unpacked."""

    def __init__(self, data: bytes) -> None:
        import numpy as np

        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.block, self.n_docs, self.n_ids, _ = struct.unpack("<5Q", data[8:48])
        at = 48
        self.names = np.frombuffer(data, "<i8", self.n_docs, at)
        self.nulls = np.frombuffer(data, np.uint8, self.n_docs, at + 8 * self.n_docs)
        self.first = np.frombuffer(data, "<i8", self.n_docs + 1, at + 9 * self.n_docs)
        n_blocks = -(-self.n_ids // self.block)
        at += 17 * self.n_docs + 8
        self.offsets = np.frombuffer(data, "<i8", n_blocks + 1, at)
        self.body = memoryview(data)[at + 8 * (n_blocks + 1) :]

    def ids(self, doc: int, upto: int | None = None):
        """Ids of a document, or of all from ``doc`` to before ``upto``, end to end."""
        import numpy as np

        lo, hi = int(self.first[doc]), int(self.first[doc + 1 if upto is None else upto])
        if lo == hi:
            return np.zeros(0, "<u4")
        b0, b1 = lo // self.block, (hi - 1) // self.block + 1
        n = min(b1 * self.block, self.n_ids) - b0 * self.block
        return unpack_bits(self.body[self.offsets[b0] : self.offsets[b1]], n, self.bits)[lo - b0 * self.block : hi - b0 * self.block]


def write_files(docs: DataFrame, folder: str, path: str | None = None, end: int = END, most: int = FILE) -> DataFrame:
    """Writes ``docs`` to ``folder``; returns part and file (in order of doc_id), name, documents and ids."""
    tokens = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyarrow import fs
        from pyspark import TaskContext

        enc, at = encoder(tokens, False), TaskContext.get().partitionId()
        names: list[int | None] = []
        ids: list = []
        held = made = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, made
            store, root = fs.FileSystem.from_uri(folder)
            store.create_dir(root, recursive=True)
            name = f"tokens-{at:08d}-{made:08d}.bin"
            mine = f"{root}/_attempt-{uuid.uuid4().hex}"
            with store.open_output_stream(mine) as out:
                out.write(to_file(names, ids, enc.vocabulary))
            store.move(mine, f"{root}/{name}")
            row = pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([made], pa.int64()), pa.array([name]), pa.array([len(names)], pa.int64()), pa.array([held], pa.int64())], ["part", "file", "name", "n_docs", "n_ids"])
            names.clear()
            ids.clear()
            held, made = 0, made + 1
            return row

        for b in batches:
            of, done = b.column(0).to_pylist(), 0
            for every, n in enc.encode(b.column(1), end):
                for own in np.split(every, np.cumsum(n)[:-1]):
                    names.append(of[done])
                    ids.append(own)
                    held, done = held + len(own), done + 1
                    if held >= most:
                        yield flush()
        if names:
            yield flush()

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ranged = read.repartitionByRange(4 * partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return ranged.mapInArrow(run, "part long, file long, name string, n_docs long, n_ids long")


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (little-endian 32-bit) from the files."""
    spark = files.sparkSession
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("m")).withColumn("all", F.lit(0))
    earlier = parts.select("part", (F.sum("m").over(Window.partitionBy("all").orderBy("part")) - F.col("m")).alias("p"))  # a row for each writing task
    inside = files.select("part", "name", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("file")) - F.col("n_ids")).alias("f"))
    before = inside.join(earlier, "part").select("name", (F.col("f") + F.col("p")).alias("before"))
    there = spark.read.format("binaryFile").option("pathGlobFilter", "tokens-*.bin").load(folder)
    named = there.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for content, base in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                f = TokenFile(content.as_py())
                for lo in range(0, f.n_docs, 256):
                    hi = min(lo + 256, f.n_docs)
                    every = f.ids(lo, hi)
                    offsets = (4 * (f.first[lo : hi + 1] - f.first[lo])).astype(np.int64)
                    ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(every))])
                    names = pa.array(f.names[lo:hi], pa.int64(), mask=f.nulls[lo:hi].astype(bool))
                    yield pa.RecordBatch.from_arrays([names, pa.array(base + f.first[lo:hi], pa.int64()), ids.cast(pa.binary())], ["doc_id", "start", "ids"])

    return named.join(before, "name").select("content", "before").mapInArrow(run, "doc_id long, start long, ids binary")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    files = written(write_files(table(spark, sf_dir, "documents"), folder), "token-manifest")
    if not files.limit(1).count():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_files(files, folder).select("doc_id", "start", F.expr("cast(length(ids) / 4 as long)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
