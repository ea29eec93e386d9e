"""Best-fit packing of documents into token sequences, after Martello-Toth dominance reduction.

Documents become pieces of at most ``capacity`` tokens in one Python pass (only
ids' lengths and checksums leave it). What is packed depends on piece lengths
alone, and there are at most ``capacity`` different ones, so the instance is a
histogram of that many rows, whatever the number of documents. The plan is made
from it: first the reduction fixes every bin whose content provably dominates
all others for its largest piece (exact complements, lone pieces, largest single
partners, dominating pairs), in bulk; then best fit decreasing packs the rest,
also in bulk, group of equal bins by group. The plan is a bounded list of slots
(length, first rank, number of bins, first sequence, offset); pieces get their
rank among those of their length by a window per length and task plus running
counts, and look their slot up. No task holds all pieces of a length.

Defined cases: null and empty text is a document of the end token alone; null
ids stay null; repeated rows are packed one by one; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskpass.llm.common import bounded_batches, col, need, stage

CAPACITY = 1024
END_ID = 2
CACHE = 400_000  # remembered chunks per Python worker
# Unicode white space as the vocabulary's pattern means it.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Chunks at whose ends the byte-level pattern always cuts, in its own order of choice.
_CHUNK = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


# The byte-level vocabulary's pattern, and its printable bytes (the
# others stand as the code points from 256 on, in order).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


class _Encoder:
    """Token ids of texts as packed little-endian 32-bit words, remembering frequent chunks.

    The vocabulary is read by ``tokenizers``. In a byte-level BPE vocabulary of this
    kind ids are merge ranks, so chunks not seen before go through ``tiktoken`` with
    these ranks, which gives the same ids (tested) four times as fast. Texts that hold one
    of the vocabulary's added tokens go through ``tokenizers`` whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer
        others = [b for b in range(256) if b not in set(PRINTABLE)]
        byte = {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(others)}
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if all(c in byte for c in token)}
        ranks = {t: i for t, i in ranks.items() if not (t.startswith(b"<|") and t.endswith(b"|>"))}
        self.encoding = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.line_end = ranks[b"\n"]
        self.known: dict[str, bytes] = {}

    def _learn(self, chunks: set[str]) -> None:
        words = [c for c in chunks if not c.isspace()]
        ids = np.array(self.encoding.encode_ordinary("".join([w + "\n" for w in words])), "<u4")
        raw, at = ids.tobytes(), 0
        for word, end in zip(words, (4 * np.flatnonzero(ids == self.line_end)).tolist()):
            self.known[word], at = raw[at:end], end + 4
        for c in chunks.difference(words):
            self.known[c] = np.array(self.encoding.encode_ordinary(c), "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """Ids of a text as ``tokenizers`` gives them with ``add_special_tokens=False``."""
        if any(t in text for t in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.packed(text)

    def packed(self, text: str) -> bytes:
        """Ids of a text in which added tokens are ordinary characters."""
        chunks = _CHUNK.findall(text)
        new = set(chunks).difference(self.known)
        if new:
            if len(self.known) > CACHE:
                self.known.clear()
                new = set(chunks)
            self._learn(new)
        return b"".join(map(self.known.__getitem__, chunks))


_ENCODERS: dict[str, _Encoder] = {}


def encoder(path: str) -> _Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = _Encoder(path)
    return _ENCODERS[path]


def cut(packed: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32): whole if it fits, else full pieces with the rest in the first."""
    n = len(packed) // 4
    start = 0
    length = n if n <= capacity else (n % capacity or capacity)
    piece = 0
    while start < n:
        yield piece, start, length, zlib.crc32(packed[4 * start:4 * (start + length)])
        piece, start, length = piece + 1, start + length, capacity


def pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str | None = None,
           capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's tokens and end token; no shuffle."""
    need(docs, id_col, text)
    bounded_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    end = np.array([END_ID], "<u4").tobytes()
    narrow = docs.select(col(id_col).alias("doc_id"), col(text).cast("string").alias("t"))
    schema = (narrow.select("doc_id").schema.add("piece", "integer").add("start", "long").add("length", "long")
              .add("ids_crc32", "long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            rows, at = [], []
            for i, t in enumerate(b.column(1)):
                for p in cut(enc.ids(t.as_py() or "") + end, capacity):
                    rows.append(p)
                    at.append(i)
            cols = [pa.array([r[k] for r in rows], (pa.int32(), pa.int64(), pa.int64(), pa.int64())[k]) for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *cols], schema.names)

    return narrow.mapInArrow(run, schema)


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Bins fixed by dominance, as (lengths, number of such bins), and the counts left.

    For the largest piece j of a bin with room r beside it: a lone j if nothing
    fits; {j, k} if k fills r, if no two pieces fit together, or if no pair that
    fits is longer than the largest single k; {j, k, b} if at most two more fit
    and k and b bound both members of every pair that fits."""
    left = {w: n for w, n in counts.items() if n > 0}
    sizes = sorted(left)
    fixed: list[tuple[tuple[int, ...], int]] = []

    def largest(limit: int, used: dict[int, int]) -> int:
        i = bisect_left(sizes, limit + 1) - 1
        while i >= 0 and left[sizes[i]] <= used.get(sizes[i], 0):
            i -= 1
        return sizes[i] if i >= 0 else 0

    def smallest(k: int, used: int) -> int:
        """Sum of the k smallest pieces beside one of length ``used`` (capacity + 1 if there are fewer)."""
        total = 0
        for w in sizes:
            n = min(k, left[w] - (w == used))
            total, k = total + n * w, k - n
            if not k:
                return total
        return capacity + 1

    def take(content: tuple[int, ...]) -> None:
        times = min(left[w] // content.count(w) for w in set(content))
        fixed.append((content, times))
        for w in content:
            left[w] -= times
        for w in set(content):
            if not left[w]:
                del left[w]
                sizes.remove(w)

    def step(j: int) -> tuple[int, ...] | None:
        r = capacity - j
        k = largest(r, {j: 1})
        if not k:
            return (j,)
        if k == r or smallest(2, j) > r:
            return (j, k)
        pair = 0  # the longest pair beside j that fits
        for a in reversed(sizes):
            if a > r or left[a] <= (a == j):
                continue
            if 2 * a < pair:
                break
            b = largest(min(r - a, a), {j: 1} if a != j else {j: 2})
            while b == a and left[a] < 2 + (a == j):
                b = largest(a - 1, {j: 1})
            pair = max(pair, a + b if b else 0)
        if smallest(3, j) > r:
            if k >= pair:
                return (j, k)
            used = {j: 1}
            used[k] = used.get(k, 0) + 1
            b = largest(r - k, used)
            if b and largest(r // 2, {j: 1}) <= b:
                return (j, k, b)
        return None

    changed = True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while left.get(j):
                content = step(j)
                if content is None:
                    break
                take(content)
                changed = True
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing over a histogram: (lengths, number of such bins), equal bins handled together."""
    rooms: list[int] = []  # sorted room of open bins
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)

    def put(content: tuple[int, ...], bins: int) -> None:
        room = capacity - sum(content)
        if bins:
            if not open_bins[room]:
                insort(rooms, room)
            open_bins[room].append((content, bins))

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            i = bisect_left(rooms, w)
            if i < len(rooms):
                room = rooms[i]
                content, bins = open_bins[room].pop()
                if not open_bins[room]:
                    rooms.pop(i)
            else:
                room, content, bins = capacity, (), -(-n // (capacity // w))
            each = room // w
            full = min(bins, n // each)
            put(content + (w,) * each, full)
            n -= full * each
            if full < bins and n:
                put(content + (w,) * n, 1)
                n, full = 0, full + 1
            put(content, bins - full) if content else None
    return [x for same in open_bins.values() for x in same]


def plan(counts: dict[int, int], capacity: int) -> dict[int, tuple[list[int], list[int], list[int]]]:
    """For each length, its slots in rank order: (first ranks, first sequences, offsets)."""
    fixed, left = reduce_dominated(counts, capacity)
    slots: dict[int, tuple[list[int], list[int], list[int]]] = defaultdict(lambda: ([], [], []))
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for content, bins in fixed + best_fit(left, capacity):
        offset = 0
        for w in content:
            ranks, firsts, offsets = slots[w]
            ranks.append(used[w])
            firsts.append(sequence)
            offsets.append(offset)
            used[w] += bins
            offset += w
        sequence += bins
    return dict(slots)


def _ranked(p: DataFrame) -> DataFrame:
    """``rank`` of every piece among those of its length, from 0, by task-wise windows and running counts."""
    sizes = p.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(F.col("length").alias("l"), F.col("part").alias("q"), (F.sum("n").over(
        Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32"))
    return (p.withColumn("nth", nth)
            .join(before, (F.col("length") == F.col("l")) & (F.col("part") == F.col("q")))
            .withColumn("rank", F.col("before") + F.col("nth") - 1).drop("nth", "before", "l", "q", "part"))


def pack_pieces(p: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``p`` (doc_id, piece, length, ids_crc32, ...) with sequence_id and offset."""
    p = stage(p.withColumn("part", F.spark_partition_id()), "pack-pieces")
    # at most ``capacity`` rows, whatever the number of documents
    counts = {r["length"]: r["n"] for r in p.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = {w: tuple(np.array(x, np.int64) for x in s) for w, s in plan(counts, capacity).items()}
    ranked = _ranked(p)
    schema = T.StructType(ranked.drop("rank").schema.fields).add("sequence_id", "long").add("offset", "long")
    names = ranked.drop("rank").columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            rank = b.column(b.schema.get_field_index("rank")).to_numpy(zero_copy_only=False)
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for w in np.unique(length):
                at = length == w
                ranks, firsts, offsets = slots[int(w)]
                i = np.searchsorted(ranks, rank[at], side="right") - 1
                sequence[at] = firsts[i] + rank[at] - ranks[i]
                offset[at] = offsets[i]
            kept = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], schema.names)

    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str | None = None,
                   capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(pieces(docs, id_col, text, vocabulary, capacity), capacity)
