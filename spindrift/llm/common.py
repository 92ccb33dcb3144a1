"""What the operators share: the shared folder, written tables, let-bindings and tokenizer caching."""

from __future__ import annotations

import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space, tab, line feed, vertical tab, form feed and carriage return: all that separates words.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[ \\t-\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _local_dir(application: str) -> str:
    """One folder for each local application; the setting itself can't be changed in a running session."""
    return "file://" + tempfile.mkdtemp(prefix="spindrift-shared-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session has one made where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _local_dir(spark.sparkContext.applicationId)
    return found.rstrip("/")


#: Folders of the ``passing`` blocks that are open, the innermost last.
_OPEN_FOLDERS: ContextVar[tuple[str, ...]] = ContextVar("_OPEN_FOLDERS", default=())


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables ``written`` inside are removed when the block ends, but for those that are ``lasting``, which belong to the block around it."""
    folder = f"{shared_dir(spark)}/passing-{uuid.uuid4().hex}"
    token = _OPEN_FOLDERS.set((*_OPEN_FOLDERS.get(), folder))
    try:
        yield
    finally:
        _OPEN_FOLDERS.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors, and is computed once."""
    spark = df.sparkSession
    inside = _OPEN_FOLDERS.get()[: -1 if lasting else None]
    path = f"{inside[-1] if inside else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, even where the body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class PieceEncoder:
    """Token ids of texts as packed little-endian 16-bit ids, by a ``tokenizers`` file.

    Both supported pre-tokenizers never join what stands on the two sides of a single white space, or a letter with
    the ASCII sign after it (but an apostrophe), so a text is cut there, the pieces of a chunk are numbered by Arrow, and only different
    pieces are looked up or encoded; ids are then gathered with numpy. ``keep_space``: a piece keeps the space before
    it (byte-level vocabularies), and a text where white space stands beside other white space is encoded whole;
    without it white space carries nothing (word-level vocabularies). Pieces of over ``LONG`` characters are not remembered, and
    what is remembered is emptied at ``most`` bytes.
    """

    LONG = 64
    #: Bytes of text that are encoded together.
    CHUNK = 4 << 20
    _SIGN = "(\\pL)([!-&(-/:-@\\[-`{-~])"
    #: Stands for "no space before this piece".
    _GLUE = "\x01"
    #: Texts that are encoded whole: white space beside white space (byte level), the mark above, or what may be a special token.
    _WHITE = "[\\s\\x0b\\x{1c}-\\x{1f}\\x{85}\\pZ]"
    _WHOLE = f"{_WHITE}{_WHITE}|\\x01|<\\|"

    def __init__(self, path: str, keep_space: bool, most: int = 48 << 20) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        if self.vocabulary > 65536:
            raise ValueError("ids of more than 16 bits")
        self.keep_space, self.most = keep_space, most
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("H", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _found(self, words: list[str]) -> list[bytes]:
        known = self.known
        out = list(map(known.get, words))
        new = [i for i, x in enumerate(out) if x is None]
        for lo in range(0, len(new), 20_000):
            at = new[lo : lo + 20_000]
            fresh = [words[i] for i in at]
            ids = self._ids(fresh)
            for i, x in zip(at, ids, strict=True):
                out[i] = x
            short = {w: x for w, x in zip(fresh, ids, strict=True) if len(w) <= self.LONG}
            known.update(short)
            self.held += sum(map(len, short)) + sum(map(len, short.values()))
        if self.held > self.most:
            known.clear()
            self.held = 0
        return out

    def _cut(self, texts: pa.Array, end: int):
        """Ids of the texts end to end, and how many each has, the end id included."""
        import numpy as np
        import pyarrow.compute as pc

        if self.keep_space:  # every piece but those after the mark has a space before it
            texts = pc.replace_substring(texts, "\n", f" {self._GLUE}\n")
            texts = pc.replace_substring_regex(texts, self._SIGN, f"\\1 {self._GLUE}\\2")
            texts = pc.binary_join_element_wise(self._GLUE, texts, "")
        else:
            texts = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), self._SIGN, "\\1 \\2")
        lists = pc.split_pattern(texts, " ")
        stops = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
        named = pc.list_flatten(lists).dictionary_encode()
        code, words = named.indices.to_numpy().astype(np.int64), named.dictionary.to_pylist()
        if self.keep_space:
            words = [w[1:] if w[:1] == self._GLUE else f" {w}" for w in words]
        ids = [*self._found(words), end.to_bytes(2, "little")]
        code = np.insert(code, stops, len(ids) - 1)
        flat = np.frombuffer(b"".join(ids), "<u2")
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        begin = np.cumsum(size) - size
        n = size[code]
        done = np.cumsum(n)
        every = flat[np.repeat(begin[code] - (done - n), n) + np.arange(done[-1])]
        last = done[stops + np.arange(len(stops))]
        return every, np.diff(last, prepend=0)

    def encode(self, texts: pa.Array, end: int):
        """Chunks of (ids end to end as unsigned 16-bit numbers, ids of each text) in order of the texts, each text's ids with ``end`` after them."""
        import numpy as np
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + self.CHUNK, "right")))
            part = texts.slice(lo, hi - lo)
            lo = hi
            odd = np.flatnonzero(pc.match_substring_regex(part, self._WHOLE if self.keep_space else "<\\|").to_numpy(zero_copy_only=False))
            if not len(odd):
                yield self._cut(part, end)
                continue
            at = 0
            for i in odd:
                if i > at:
                    yield self._cut(part.slice(at, i - at), end)
                ids = np.frombuffer(self._ids([part[i].as_py()])[0] + end.to_bytes(2, "little"), "<u2")
                yield ids, np.array([len(ids)])
                at = i + 1
            if at < len(part):
                yield self._cut(part.slice(at), end)


def packed(every, n) -> pa.Array:
    """Binary values of ``n`` 16-bit ids each, cut from ``every``; no copy is made."""
    import numpy as np

    offsets = np.concatenate(([0], np.cumsum(n) * 2)).astype(np.int64)
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(every))])
    return whole.cast(pa.binary())


_encoders: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, keep_space: bool) -> PieceEncoder:
    """One for each worker process, so that what it remembers lives on over tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    key = (path, keep_space)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(path, keep_space)
    return _encoders[key]
