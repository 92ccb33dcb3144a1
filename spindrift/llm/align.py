"""Alignment of the tokens of two tokenizers: A, a byte-level vocabulary, and B, a vocabulary of pieces.

Both tokenize the same bytes (a space and the text). Where tokens of both end, the bytes are cut into groups; an A and a B token whose
bytes overlap are linked. How often two ids are linked in all documents says which A id stands for a B id.

**Arrow pipeline.** Texts are cut into units where neither tokenizer ever joins: before a single space or line feed with
no white space beside it, and between a letter and a sign that no piece of B has after a letter. Arrow numbers a chunk's units, and only different ones are tokenized and aligned, so that a document is a
list of units. Token lists are flattened with their parent indices; segmented cumulative sums of token lengths give
the bytes at which tokens end; an Acero hash join (full outer) on (unit, end) meets ends of A and B. Each row of the join is the end of one
overlap: where a side has no token ending there, the next one that ends covers it. ``Table.group_by`` counts
linked ids of a chunk, weighted by how often units occur, and Spark adds the chunks up.

**Corpus-wide counts back to documents.** A chunk's rows (its documents as unit numbers, its units as numbers of id pairs, its id
pairs with partial counts) are one written table. Only the id pairs of chunks are shuffled and joined to the total counts, and a
chunk then meets its own pairs in one cogroup. So neither texts nor links are shuffled, nothing is broadcast, and a task holds
a chunk (``CHUNK`` bytes of text, or one longer text) whatever the data. An id pair that
every chunk holds comes once from each chunk.

Texts that are null or empty, and those whose A or B tokens don't spell the bytes (as where a text holds U+2581), have no tokens:
zeros and an empty string. Repeated rows count and come out as often as they occur; null ids stay null; other columns are not
read. An empty table gives an empty result. Special tokens' strings in texts are plain text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import table, written

#: Bytes of text that are aligned together.
CHUNK = 3 << 20
#: Units that a worker process remembers (in each of two generations), and characters of the longest among them.
REMEMBERED = 200_000
LONG = 64
#: Signs before which a unit may begin, after a letter.
SIGNS = ",.;:!?"
NAMES = ["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "units", "pairs", "times", "unit_links", "link_pairs"]
KINDS = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, units binary, pairs array<long>, times array<long>, unit_links binary, link_pairs binary"


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_level() -> dict[str, int]:
    """The bytes that the characters of a byte-level entry stand for: printable ones for themselves, the others in order from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """The two tokenizers: ids of units, and the bytes of ids."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        to_byte = byte_level()
        entries = sorted(self.a.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        if max(entries[-1][1], self.b.get_piece_size() - 1) > 65535:
            raise ValueError("ids of more than 16 bits")
        a_bytes: list[bytes] = [b""] * (entries[-1][1] + 1)
        for entry, i in entries:
            a_bytes[i] = bytes(to_byte[c] for c in entry) if all(c in to_byte for c in entry) else entry.encode()
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if raw else p.replace("▁", " ").encode() for p, raw in pieces]
        self.bytes_of = (pa.array(a_bytes, pa.binary()), pa.array(b_bytes, pa.binary()))
        self.signs = "".join(c for c in SIGNS if not any(re.search(f"[A-Za-zÀ-ÿ]{re.escape(c)}", p) for p, _ in pieces))
        self.first = self.b.encode("\n")  # what stands before a unit that begins with no space
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}

    def ids(self, units: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Of each unit, A's and B's ids as 16-bit numbers."""
        from array import array

        out = list(map(self.known.get, units))
        new = []
        for i, x in enumerate(out):
            if x is None:
                out[i] = x = self.older.get(units[i])
                if x is None:
                    new.append(i)
                else:
                    self.known[units[i]] = x
        skip = len(self.first)
        for lo in range(0, len(new), 20_000):
            at = new[lo : lo + 20_000]
            fresh = [units[i] for i in at]
            a = self.a.encode_batch_fast(fresh, add_special_tokens=False)
            # B puts a space before what it is given: the unit's own, or one before a line feed, which no piece joins
            b = self.b.encode([u[1:] if u[:1] == " " else f"\n{u}" for u in fresh], num_threads=1)
            for i, u, x, y in zip(at, fresh, a, b, strict=True):
                out[i] = (array("H", x.ids).tobytes(), array("H", y if u[:1] == " " else y[skip:]).tobytes())
                if len(u) <= LONG:
                    self.known[u] = out[i]
            if len(self.known) > REMEMBERED:
                self.known, self.older = {}, self.known
        return [x for x, _ in out], [y for _, y in out]


_pairs: dict[tuple[str, str], Pair] = {}


def _tokenizers(of: tuple[str, str]) -> Pair:
    """One for each worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    if of not in _pairs:
        _pairs[of] = Pair(*of)
    return _pairs[of]


def cut(texts: list[bytes], signs: str = ""):
    """The units of ``texts``, each text after a space, and how many each text has."""
    import numpy as np

    raw = b"".join(x for t in texts for x in (b" ", t)) + b"\0\0\0"
    b = np.frombuffer(raw, np.uint8)
    n = len(b) - 3
    one_of = lambda x: np.isin(np.arange(256), list(x))
    white = one_of([9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
    wide = one_of([0xE1, 0xE2, 0xE3])  # lead bytes of further white space
    last = one_of([0x85, 0xA0])  # after 0xC2
    size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begin = np.cumsum(size) - size
    begins = np.zeros(n + 1, bool)
    begins[begin] = begins[n] = True
    at = np.flatnonzero(one_of([10, 32])[b[:n]])
    at = at[~begins[at] & ~begins[at + 1]]  # a last space has nothing after it
    x, y, z = b[at - 1], b[np.maximum(at - 2, 0)], b[np.maximum(at - 3, 0)]
    v, w = b[at + 1], b[at + 2]
    apart = ~(white[x] | wide[z] | ((y == 0xC2) & last[x]) | white[v] | wide[v] | ((v == 0xC2) & last[w]))
    cuts = begins.copy()
    cuts[at[apart]] = True
    at = np.flatnonzero(one_of(signs.encode())[b[:n]])
    letters = one_of(range(97, 123)) | one_of(range(65, 91))
    x, y = b[at - 1], b[np.maximum(at - 2, 0)]
    cuts[at[letters[x] | ((y == 0xC3) & (x != 0x97) & (x != 0xB7))]] = True  # letters of one byte, and those from U+00C0 to U+00FF
    offsets = np.flatnonzero(cuts).astype(np.int32)
    units = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(raw))
    return units, np.diff(np.append(np.flatnonzero(begins[offsets[:-1]]), len(units)))


def _lists(ids: list[bytes]) -> pa.ListArray:
    import numpy as np

    offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 2))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<u2").astype(np.int32)))


def _ends(lists: pa.ListArray, spelled: pa.Array, side: str) -> pa.Table:
    """unit, end (bytes of the unit up to the token's end) and the id of every token."""
    import pyarrow.compute as pc

    ids, unit = pc.list_flatten(lists), pc.list_parent_indices(lists)
    upto = pc.cumulative_sum(pc.cast(pc.binary_length(spelled.take(ids)), pa.int64()))
    upto = pa.concat_arrays([pa.array([0], pa.int64()), upto])
    first = upto.take(lists.offsets[:-1])
    end = pc.subtract(upto.slice(1), first.take(unit))
    return pa.table([pc.cast(unit, pa.int64()), end, ids], names=["unit", "end", side])


class Aligned:
    """Links of units, in order: ``unit``, ``a``, ``b`` of each; ``group_ends``: whether a group ends with it."""

    def __init__(self, units: pa.Array, of: Pair) -> None:
        import numpy as np
        import pyarrow.compute as pc

        a, b = (_lists(x) for x in of.ids(units.to_pylist()))
        spelled = [pc.binary_join(pa.ListArray.from_arrays(x.offsets, s.take(x.values)), b"") for x, s in zip((a, b), of.bytes_of, strict=True)]
        raw = units.cast(pa.binary())
        self.sound = pc.and_(*[pc.fill_null(pc.equal(s, raw), False) for s in spelled]).to_numpy(zero_copy_only=False)
        ends = [_ends(x, s, side).filter(pc.equal(pa.array(self.sound).take(pc.list_parent_indices(x)), True)) for x, s, side in zip((a, b), of.bytes_of, "ab", strict=True)]
        met = ends[0].join(ends[1], ["unit", "end"], join_type="full outer", use_threads=False).combine_chunks().sort_by([("unit", "ascending"), ("end", "ascending")])
        has_a, has_b = (pc.is_valid(met[side]).to_numpy(zero_copy_only=False) for side in "ab")
        self.group_ends = has_a & has_b
        self.unit = met["unit"].to_numpy()
        self.a, self.b = (pc.fill_null_backward(met[side].combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64) for side in "ab")
        self.n_units, self.all = len(units), slice(None)
        self._has = (has_a, has_b)

    def per_unit(self) -> list:
        """Tokens of A and of B, groups and links of each unit."""
        import numpy as np

        return [np.bincount(self.unit[x], minlength=self.n_units) for x in (*self._has, self.group_ends, self.all)]

    def said(self) -> pa.Array:
        """Each unit's groups as text: ids of A and of B between commas, ``|`` between the two, ``;`` between groups."""
        import numpy as np
        import pyarrow.compute as pc

        group = np.cumsum(self.group_ends) - self.group_ends  # number of the group that a link is in
        sides = []
        for ids, has in zip((self.a, self.b), self._has, strict=True):
            n = np.bincount(group[has], minlength=int(self.group_ends.sum()))
            offsets = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
            sides.append(pc.binary_join(pa.ListArray.from_arrays(offsets, pc.cast(pa.array(ids[has]), pa.string())), ","))
        groups = pc.binary_join_element_wise(*sides, "|")
        n = np.bincount(self.unit[self.group_ends], minlength=self.n_units)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), groups), ";")


def _sums(values, n):
    """Sums of consecutive runs of ``n`` values."""
    import numpy as np

    upto = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    ends = np.cumsum(n)
    return upto[ends] - upto[ends - n]


def _chunk_rows(number: int, doc_ids: list, texts: list[bytes], of: Pair) -> Iterator[pa.RecordBatch]:
    import numpy as np
    import pyarrow.compute as pc

    units, n = cut(texts, of.signs)
    named = units.dictionary_encode()
    code = named.indices.to_numpy().astype(np.int64)
    links = Aligned(named.dictionary, of)
    some = np.array([bool(t) for t in texts])  # an empty text's space is no token
    code = code[np.repeat(some, n)]
    n = np.where(some, n, 0)
    bad = _sums(~links.sound[code], n) > 0
    code = code[np.repeat(~bad, n)]
    n = np.where(bad, 0, n)
    per_unit = links.per_unit()
    measures = [_sums(x[code], n) for x in per_unit]
    said = links.said().take(pa.array(code))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), said), ";")
    digests = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in joined.to_pylist()]
    blob, at = code.astype("<u4").tobytes(), np.concatenate(([0], np.cumsum(n))).tolist()
    lists = [blob[4 * lo : 4 * hi] for lo, hi in zip(at, at[1:], strict=False)]
    rows = len(doc_ids)
    own = [pa.array([number] * rows, pa.int64()), pa.array(doc_ids, pa.int64()), *[pa.array(x, pa.int64()) for x in measures], pa.array(digests, pa.string()), pa.array(lists, pa.binary())]
    blank = [pa.nulls(rows, pa.list_(pa.int64()))] * 2 + [pa.nulls(rows, pa.binary())] * 2
    yield pa.RecordBatch.from_arrays([*own, *blank], NAMES)
    times = np.bincount(code, minlength=links.n_units)
    counted = pa.table({"pair": (links.a << 16) | links.b, "n": times[links.unit]}).group_by("pair", use_threads=False).aggregate([("n", "sum")])
    pairs = counted["pair"].to_numpy()
    order = np.argsort(pairs)
    pairs, sums = pairs[order], counted["n_sum"].to_numpy()[order]
    link_pairs = np.searchsorted(pairs, (links.a << 16) | links.b).astype("<u4").tobytes()
    one = [pa.array([number], pa.int64()), *[pa.nulls(1, pa.int64())] * 5, pa.nulls(1, pa.string()), pa.nulls(1, pa.binary())]
    lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (pairs, sums)]
    yield pa.RecordBatch.from_arrays([*one, *lists, pa.array([per_unit[3].astype("<u4").tobytes()], pa.binary()), pa.array([link_pairs], pa.binary())], NAMES)


def chunks(docs: DataFrame, of: tuple[str, str], size: int = CHUNK) -> DataFrame:
    """A row for each document, and one with its pairs and units for each chunk of about ``size`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both, number = _tokenizers(of), TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list[bytes] = []
        held = 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                held += len(t) + 1
                if held >= size:
                    yield from _chunk_rows(number, ids, texts, both)
                    ids, texts, held, number = [], [], 0, number + 1
        if ids:
            yield from _chunk_rows(number, ids, texts, both)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, KINDS)


def pair_counts(made: DataFrame) -> DataFrame:
    """pair (A's id times 65,536 and B's id), n (links of the two in all documents) and best (1: none of B's pairs has more)."""
    each = made.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    total = each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n")).where("n > 0")
    total = written(total.withColumn("b", F.col("pair").bitwiseAND(65535)), "pair-counts")
    most = total.groupBy("b").agg(F.max("n").alias("most"))
    return total.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))


def _with_counts(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of a chunk (``left``) with n_best and count_sum; ``right``: place, n and best of its pairs."""
    import numpy as np
    import pyarrow.compute as pc

    whole = left.filter(pc.is_valid(left["pairs"]))
    docs = left.filter(pc.is_null(left["pairs"]))
    blob = lambda c: np.frombuffer(whole[c][0].as_py(), "<u4").astype(np.int64)
    of_pair = np.zeros((2, len(whole["pairs"][0])), np.int64)
    of_pair[:, right["place"].to_numpy()] = [right["n"].to_numpy(), right["best"].to_numpy()]
    by_link, per_unit = of_pair[:, blob("link_pairs")], blob("unit_links")
    lists = docs["units"].combine_chunks()
    sizes = pc.fill_null(pc.binary_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    codes = np.frombuffer(b"".join(lists.to_pylist()), "<u4").astype(np.int64)
    count_sum, n_best = (_sums(_sums(x, per_unit)[codes], sizes) for x in by_link)
    keep = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    return pa.table([*[docs[c] for c in keep], n_best, count_sum, docs["groups_sha256"]], names=[*keep, "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, of: tuple[str, str] | None = None, size: int = CHUNK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    made = written(chunks(docs, of or paths(), size), "aligned")
    own = made.where("pairs is not null").select(F.col("chunk").alias("in_chunk"), F.posexplode("pairs").alias("place", "pair"))
    weights = own.join(pair_counts(made), "pair").select("in_chunk", "place", "n", "best")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return made.drop("times").groupBy("chunk").cogroup(weights.groupBy("in_chunk")).applyInArrow(_with_counts, out)


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
