"""Removal of repeated passages by prefix-free parsing.

A text is parsed into phrases by rolling-hash triggers: of the ``GRAM``-byte hashes inside a window of
``LENGTH`` bytes the smallest (leftmost, if tied) is the window's trigger, and the windows that
share a trigger make one phrase, which spans their bytes. Phrases overlap by ``LENGTH - 1`` bytes, so
every window lies in exactly one phrase, and as a trigger depends on its window alone, equal
windows have equal triggers: no match is lost.

1. Dictionary. Phrases are put in order by trigger, content and place in the corpus. All but
   the first of equal phrases are repeats, whole. A first phrase can only hold a window seen
   elsewhere if another phrase of the dictionary has its trigger.
2. Those few phrases are opened: their windows (the suffixes of the dictionary that are long
   enough to count) are compared in order of place under their trigger, and all but the first of
   equal ones repeat. Phrases of a trigger with over ``FREQUENT`` phrases are opened before they
   are dealt, and their windows dealt by content, so that no trigger is one task's burden.
3. Both lists meet the texts, and covered bytes are cut.

Order is found by hash rather than by a byte-wise sort of all suffixes, since only adjacency of equals is
asked for: 128 bits for phrases (trigger and content) and for windows. A phrase or window that
repeats inside one batch of a task is settled there, so that a frequent passage sends a row
for each batch and not for each copy; what is settled is dealt out by document.

A null text is empty. Texts under ``LENGTH`` bytes are kept whole. Rows that repeat a doc_id with
the same text are one document and all get its result; with other texts, the text's hash orders them.
A null doc_id orders before all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.llm.common import partitions, table, written

LENGTH = 100
GRAM = 24
#: Bytes hashed at a time.
CHUNK = 1 << 20
#: Phrases of a trigger that are compared in one place.
FREQUENT = 5_000
_POS = 22
_NONE = -(2**63)


def _mix(a, b):
    import numpy as np

    x = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


def gram_hashes(data):
    """Hashes of all ``GRAM`` bytes long pieces of ``data`` (unsigned bytes), by doubling."""
    import numpy as np

    h1 = _mix((data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), np.full(1, 7, np.uint64))
    h2 = _mix(h1[:-1], h1[1:])
    h4 = _mix(h2[:-2], h2[2:])
    h8 = _mix(h4[:-4], h4[4:])
    h16 = _mix(h8[:-8], h8[8:])
    return _mix(h16[:-8], h8[16:])


def phrases(data, starts, ends):
    """The phrases of the texts ``data[starts[i]:ends[i]]`` laid end to end: first window, windows, trigger's hash."""
    import numpy as np

    h = gram_hashes(data)
    width = LENGTH - GRAM + 1
    low = np.uint64((1 << _POS) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    done = 1
    while done < width:
        step = min(done, width - done)
        m = np.minimum(m[:-step], m[step:])
        done += step
    trigger = (m & low).astype(np.int64)  # of each window of the chunk
    good = np.zeros(len(m) + 1, np.int32)
    has = ends - starts >= LENGTH
    np.add.at(good, starts[has], 1)
    np.add.at(good, ends[has] - LENGTH + 1, -1)
    good = np.cumsum(good[:-1]) > 0
    new = good.copy()
    new[1:] &= (trigger[1:] != trigger[:-1]) | ~good[:-1]
    new[starts[has]] = True
    first = np.flatnonzero(new)
    ordinal = np.cumsum(new) - 1
    count = np.bincount(ordinal[good], minlength=len(first)) if len(first) else np.zeros(0, np.int64)
    return first, count, h[trigger[first]].view(np.int64)


def _first_in_batch(key, also, *order):
    """Marks the first of rows equal in ``key`` and ``also`` by ``order`` (last key first, as for lexsort)."""
    import numpy as np

    by = np.lexsort((*order, also, key))
    mark = np.ones(len(key), bool)
    mark[by[1:]] = (key[by][1:] != key[by][:-1]) | (also[by][1:] != also[by][:-1])
    return mark


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    for b in batches:
        cols: list[list] = [[], [], [], [], [], []]
        held: list[tuple] = []

        def flush() -> None:
            data = b"".join(p for *_, p in held)
            if len(data) >= LENGTH:
                ends = np.cumsum([len(p) for *_, p in held])
                starts = ends - np.array([len(p) for *_, p in held])
                first, count, gram = phrases(np.frombuffer(data, np.uint8), starts, ends)
                of = np.searchsorted(ends, first, "right")
                stop = first + count + LENGTH - 1
                said = np.fromiter((digest(data[i:j]) for i, j in zip(first.tolist(), stop.tolist(), strict=True)), np.uint64, len(first)).view(np.int64)
                names, hashes, bases = (np.array([x[i] for x in held], np.int64) for i in range(3))
                for c, v in zip(cols, (gram, said, names[of], hashes[of], first - starts[of] + bases[of], count), strict=True):
                    c.append(v)
            held.clear()

        size = 0
        for doc, mark, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            whole = text.encode()
            for at in range(0, max(1, len(whole) - LENGTH + 1), CHUNK):
                part = whole[at : at + CHUNK + LENGTH - 1]
                held.append((doc, mark, at, part))
                size += len(part)
                if size >= CHUNK:
                    flush()
                    size = 0
        flush()
        if cols[0]:
            gram, said, doc, mark, at, count = (np.concatenate(c) for c in cols)
            sure = ~_first_in_batch(gram, said, at, mark, doc)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram, said, doc, mark, at, count, sure)], ["gram", "said", "doc", "mark", "at", "n", "sure"])


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of a trigger (or of a window's hash) together, what is settled by document."""
    key = F.when(F.col("sure"), F.xxhash64("doc", "at")).otherwise(F.col("gram"))
    return rows.withColumn("key", key).repartition(partitions(rows.sparkSession), "key")


def _ordered(rows: DataFrame) -> DataFrame:
    """Phrases that repeat (state 1) or whose trigger has other phrases too (state 2, with their number)."""
    dealt = _dealt(rows)
    inside = Window.partitionBy("key").orderBy("said", "doc", "mark", "at")
    whole = Window.partitionBy("key")
    seen = F.coalesce(F.lag("said").over(inside) == F.col("said"), F.lit(False))
    many = F.min("said").over(whole) != F.max("said").over(whole)
    state = F.when(F.col("sure") | F.col("seen"), F.lit(1)).when(F.col("many"), F.lit(2))
    marked = dealt.withColumn("seen", seen).withColumn("many", many).withColumn("size", F.count("*").over(whole)).withColumn("state", state)
    return marked.where("state is not null").select("gram", "doc", "mark", "at", "n", "state", "size")


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases to compare, by trigger; those of frequent triggers as windows by content."""
    import numpy as np
    import xxhash

    digest = xxhash.xxh3_128_digest
    for b in batches:
        for i in range(0, b.num_rows, 1024):
            part = b.slice(i, 1024).to_pydict()
            out: list[tuple] = []
            said, place = [], []
            for d, h, text, runs in zip(part["doc"], part["mark"], part["text"], part["runs"], strict=True):
                whole = text.encode()
                for r in runs:
                    at, n = r["at"], r["n"]
                    if r["size"] <= FREQUENT:
                        out.append((r["gram"], 0, d, h, at, n, False, whole[at : at + n + LENGTH - 1]))
                    else:
                        said += [digest(whole[k : k + LENGTH]) for k in range(at, at + n)]
                        place += [(d, h, k) for k in range(at, at + n)]
            if said:
                pair = np.frombuffer(b"".join(said), "<i8").reshape(-1, 2)
                doc, mark, at = np.array(place, np.int64).T
                sure = ~_first_in_batch(pair[:, 0], pair[:, 1], at, mark, doc)
                key = np.where(sure, doc * 0x9E3779B1 + at, pair[:, 0])
                out += zip(key.tolist(), pair[:, 1].tolist(), doc.tolist(), mark.tolist(), at.tolist(), [1] * len(at), sure.tolist(), [None] * len(at), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(_OPEN_TYPES)], _OPEN_NAMES)


_OPEN_NAMES = ["key", "said", "doc", "mark", "at", "n", "sure", "body"]
_OPEN_TYPES = [pa.int64()] * 6 + [pa.bool_(), pa.binary()]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows that an earlier row of the same key has; rows come in order of key and place."""
    import numpy as np

    key, seen = None, set()
    for b in batches:
        part, out = b.to_pydict(), []
        for k, said, doc, mark, at, n, sure, body in zip(*(part[c] for c in _OPEN_NAMES), strict=True):
            if k != key:
                key, seen = k, set()
            if sure:
                out.append((doc, mark, at, 1))
                continue
            items = [said] if body is None else [body[i : i + LENGTH] for i in range(n)]
            last = None
            for i, item in enumerate(items, at):
                if item not in seen:
                    seen.add(item)
                elif last == i - 1:
                    out[-1] = (doc, mark, out[-1][2], out[-1][3] + 1)
                    last = i
                else:
                    out.append((doc, mark, i, 1))
                    last = i
        cols = np.array(out, np.int64).reshape(-1, 4).T
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["doc", "mark", "at", "n"])


_ROWS = "gram long, said long, doc long, mark long, at long, n long, sure boolean"


def repeated(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts (doc, mark, text) and, by (doc, mark), the runs of windows that repeat earlier ones."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE))
    once = not docs.groupBy(doc).count().where("count > 1").limit(1).count()
    named = docs.select(doc.alias("doc"), (F.lit(0).cast("long") if once else F.xxhash64(text)).alias("mark"), text.alias("text"))
    single = named if once else written(named.dropDuplicates(["doc", "mark"]), "single")  # else a repeated row would repeat itself
    flagged = written(_ordered(single.mapInArrow(_parse, _ROWS)), "phrases")
    texts = named.repartition(partitions(spark), "doc")
    unsure = flagged.where("state = 2").groupBy("doc", "mark").agg(F.collect_set(F.struct("gram", "at", "n", "size")).alias("runs"))
    opened = (texts if once else single).join(unsure, ["doc", "mark"]).select("doc", "mark", "text", "runs").mapInArrow(_open, "key long, said long, doc long, mark long, at long, n long, sure boolean, body binary")
    near = opened.repartition(partitions(spark), "key").sortWithinPartitions("key", "doc", "mark", "at")
    found = near.mapInArrow(_compare, "doc long, mark long, at long, n long")
    runs = flagged.where("state = 1").select("doc", "mark", "at", "n").union(found).groupBy("doc", "mark").agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    return texts, runs


def remove_repeats(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (if asked for) ``kept``, the bytes left of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024).to_pydict()
                out: list[tuple] = []
                for doc, text, runs in zip(part["doc"], part["text"], part["runs"], strict=True):
                    whole = text.encode()
                    kept, removed, spans = whole, 0, 0
                    if runs:
                        at = np.array([r["at"] for r in runs])
                        edge = np.zeros(len(whole) + 1, np.int64)
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + np.array([r["n"] for r in runs]) + LENGTH - 1, -1)
                        gone = np.cumsum(edge[:-1]) > 0
                        removed, spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                        kept = np.frombuffer(whole, np.uint8)[~gone].tobytes()
                    out.append((None if doc == _NONE else doc, len(whole), removed, spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    texts, runs = repeated(docs)
    met = texts.join(runs, ["doc", "mark"], "left").select("doc", "text", "runs")
    return met.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False).drop("kept")
