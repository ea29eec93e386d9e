"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is the majority of the XXH64 hashes (seed 42) of the text's
word shingles. Two fingerprints link if they differ in at most ``max_bits`` bits.

The anchors are a covering code: bits 0-22 and 23-45 by the perfect binary Golay
code (radius 3 each), bits 46-60 by the perfect Hamming code of length 15 (radius
1), bits 61-63 free; 2^35 anchors with covering radius 7. If x and y differ in at
most d bits, some z lies within d/2 (rounded up) of both, and z's own anchor lies
within radius + d/2 of both; so it is enough to replicate each fingerprint to the
anchors of all points within d/2 of it (the sharper reach of Afrati, Das Sarma,
Rajaraman, Rule, Salihoglu, Ullman: "Anchor-points algorithms for Hamming and edit
distances", ICDT 2014, in place of radius + d). For d = 2 that is about 16 anchors
a fingerprint, against about 150. Fingerprints are compared within an anchor only.

Copies are one distinct fingerprint before anything is replicated. An anchor with
more than ``CELL`` fingerprints (many near copies) is not compared in pairs: its
fingerprints go to the finest covering code, radius 0, where every point is an
anchor. Those that share a point z within d/2 of both differ by at most d, with no
comparison left to do, and a point has at most 65 of them for d = 2; each links to
the smallest. No link between different fingerprints is lost, and the output is
linear in the distinct fingerprints.

Defined cases: null, empty and wordless texts have fingerprint zero and link like
any other; fewer words than the shingle length make one shingle; repeated rows link
to each other; rows without an id take part in links, and a component without any id
has a null component id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskpass.llm.common import bounded_batches, col, free_name, need, stage
from deskpass.llm.components import components

SEED = 42
CELL = 16
# Generator polynomials of the binary Golay code (23, 12) and of the
# Hamming code (15, 11).
GOLAY_POLYNOMIAL = 0b101011100011
HAMMING_POLYNOMIAL = 0b10011


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of the A-Z-lower-cased text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        joined, n = iter([b" ".join(words)]), 1
    else:
        n = len(words) - shingle + 1
        joined = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    h = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = h[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp) of every row, fp as a signed long; one pass, no shuffle."""
    need(docs, id_col, text)
    bounded_batches(docs.sparkSession)
    body = col(text).cast("string")
    narrow = docs.select(col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("text_hash"), body.alias("t"))
    schema = narrow.drop("t").schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], schema.names)

    return narrow.mapInArrow(run, schema)


@lru_cache
def _nearest(length: int, polynomial: int, radius: int) -> np.ndarray:
    """For each word of a perfect cyclic code's space, its codeword: codeword + each error up to the radius."""
    words = np.zeros(1, np.int64)
    for i in range(length - polynomial.bit_length() + 1):
        words = np.concatenate([words, words ^ (polynomial << i)])
    table = np.empty(1 << length, np.int32)
    for weight in range(radius + 1):
        for bits in combinations(range(length), weight):
            table[words ^ sum(1 << i for i in bits)] = words
    return table


def _anchor(x: np.ndarray) -> np.ndarray:
    golay = _nearest(23, GOLAY_POLYNOMIAL, 3)
    hamming = _nearest(15, HAMMING_POLYNOMIAL, 1)
    low = np.int64((1 << 23) - 1)
    return (golay[x & low].astype(np.int64)
            | golay[(x >> np.int64(23)) & low].astype(np.int64) << np.int64(23)
            | hamming[(x >> np.int64(46)) & np.int64((1 << 15) - 1)].astype(np.int64) << np.int64(46))


def _masks(reach: int, bits: int) -> list[np.int64]:
    return [np.uint64(sum(1 << i for i in c)).astype(np.int64) for k in range(reach + 1) for c in combinations(range(bits), k)]


def anchors(fps: DataFrame, max_bits: int) -> DataFrame:
    """(anchor, fp): every fingerprint at the anchors of all points within half the threshold."""
    masks = _masks(-(-max_bits // 2), 61)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_fps = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(all_fps), 4096):
                x = all_fps[at:at + 4096]
                a = np.sort(np.stack([_anchor(x ^ m) for m in masks], axis=1), axis=1)
                new = np.ones(a.shape, bool)
                new[:, 1:] = a[:, 1:] != a[:, :-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[new]), pa.array(np.repeat(x, new.sum(axis=1)))], ["anchor", "fp"])

    return fps.select("fp").mapInArrow(run, T.StructType().add("anchor", "long").add("fp", "long"))


def links(fps: DataFrame, max_bits: int, cell: int = CELL) -> DataFrame:
    """(a, b): links that connect what is linked, among distinct fingerprints ``fps``."""
    at = anchors(fps, max_bits)
    cells = (at.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"))
             .where("n > 1"))
    cells = stage(cells, "simhash-cells")
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits
    two = cells.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).where(near("a", "b"))
    more = stage(at.join(cells.where("n > 2").select("anchor", "n"), "anchor"), "simhash-shared")
    few = more.where(F.col("n") <= cell)
    few = (few.select("anchor", F.col("fp").alias("a"))
           .join(few.select("anchor", F.col("fp").alias("b")), "anchor")
           .where((F.col("a") < F.col("b")) & near("a", "b")).select("a", "b"))
    crowd = more.where(F.col("n") > cell).select("fp").distinct()
    masks = F.array(*[F.lit(int(m)) for m in _masks(-(-max_bits // 2), 64)])
    points = crowd.select("fp", F.explode(masks).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("z"))
    # every two fingerprints of a point z differ by max_bits at most if max_bits is even
    star = (points.select("fp", F.min("fp").over(Window.partitionBy("z")).alias("b"))
            .where(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b"))
    if max_bits % 2:
        star = star.where(near("a", "b")).unionByName(_odd(points, max_bits))
    return two.unionByName(few).unionByName(star).distinct()


def _odd(points: DataFrame, max_bits: int) -> DataFrame:
    """For an odd threshold a point's fingerprints may be one bit too far apart: compare them (a bounded set per point)."""
    p = points.select("z", F.col("fp").alias("a"))
    return (p.join(points.select("z", F.col("fp").alias("b")), "z")
            .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("a", "b"))


def _labelled(docs: DataFrame, id_col: str, text: str, shingle: int, max_bits: int, cell: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their fingerprint, distinct fingerprints with the row that stays for their component)."""
    rows = stage(fingerprints(docs, id_col, text, shingle), "simhash-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    fps = stage(rows.groupBy("fp").agg(first), "simhash-distinct")
    roots = components(links(fps, max_bits, cell))
    linked = fps.join(roots, F.col("fp") == F.col("node")).select("fp", "first", "root")
    linked = stage(linked, "simhash-linked")
    best = linked.groupBy("root").agg(F.min("first").alias("first"))
    named = linked.select("fp", "root").join(best, "root").select("fp", "first")
    alone = fps.join(linked, "fp", "left_anti").select("fp", "first")
    return rows, stage(named.unionByName(alone), "simhash-labels")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3,
                       max_bits: int = 2, cell: int = CELL) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits) and component_id, the smallest reachable id."""
    rows, labels = _labelled(docs, id_col, text, shingle, max_bits, cell)
    return rows.join(labels, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3,
                  max_bits: int = 2, cell: int = CELL) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id (ids before nulls; of equal rows, one)."""
    _, labels = _labelled(docs, id_col, text, shingle, max_bits, cell)
    names = docs.columns
    s_id, s_hash = free_name(docs, "stay_id"), free_name(docs, "stay_hash")
    stay = labels.select(F.col("first.doc_id").alias(s_id), F.col("first.text_hash").alias(s_hash)).distinct()
    h = free_name(docs, "text_hash")
    j = docs.withColumn(h, F.xxhash64(F.coalesce(col(text).cast("string"), F.lit(""))))
    j = j.join(stay, col(id_col).eqNullSafe(col(s_id)) & (col(h) == col(s_hash)))
    nth = free_name(j, "nth")
    j = j.withColumn(nth, F.row_number().over(Window.partitionBy(col(s_id), col(s_hash)).orderBy(col(s_id))))
    return j.where(col(nth) == 1).select(*[col(c) for c in names])
