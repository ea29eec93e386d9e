"""Sharding by extendible hashing.

Every row has a key hash; a shard is a prefix of its bits. A prefix is split on its next
bit only while its rows' bytes pass the limit, so shards differ in depth and each fits.
The directory is kept in levels: sizes are counted per prefix of a first, global depth
(map-side combined, two columns a row), every shard no deeper than that is read off the
counts alone, and only rows under a prefix that is still too large are counted again at a
greater depth. Rows find their shard by an equi-join on the level's prefix. Text is read
for its length only, and never shuffled to assign shards.

Rows whose keys are equal have equal hashes; when all ``KEY_BITS`` bits are used up, further
bits come from a hash of the row's place in the written length table, which splits a key
that holds any number of rows. A single row over the limit is a shard of its own, marked.

Defined cases: a null key is a key like any other; null text has no bytes; repeated rows
are assigned one by one; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskpass.llm.common import col, free_name, need, stage

LIMIT = 16 << 20    # bytes of text a shard may hold
KEY_BITS = 60       # bits of the md5 of the key; as many of the row's own hash follow
STEP = 6            # bits by which a level goes deeper than the one before


def key_bits(key: Column) -> Column:
    """The first 60 bits of the key's md5, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("\x00null"))), 1, 15), 16, 10).cast("long")


def _prefix(depth: int) -> Column:
    """The first ``depth`` of the 120 bits in h1 and h2, as two longs."""
    if depth <= KEY_BITS:
        return F.struct(F.shiftright("h1", KEY_BITS - depth).alias("a"), F.lit(0).cast("long").alias("b"))
    return F.struct(F.col("h1").alias("a"), F.shiftright("h2", 2 * KEY_BITS - depth).alias("b"))


def _shorten(depth: int, to: Column) -> Column:
    """A prefix p of ``depth`` bits, cut to ``to`` bits."""
    right = lambda x, n: F.call_function("shiftright", x, n.cast("int"))
    a, b = F.col("p.a"), F.col("p.b")
    if depth <= KEY_BITS:
        return F.struct(right(a, depth - to).alias("a"), b.alias("b"))
    return (F.when(to >= KEY_BITS, F.struct(a.alias("a"), right(b, depth - to).alias("b")))
            .otherwise(F.struct(right(a, KEY_BITS - to).alias("a"), F.lit(0).cast("long").alias("b"))))


def _name(p: str, depth: Column) -> Column:
    """The prefix's bits as text."""
    key = F.least(depth, F.lit(KEY_BITS))
    first = F.lpad(F.bin(F.col(f"{p}.a")), KEY_BITS, "0")
    more = F.lpad(F.bin(F.col(f"{p}.b")), KEY_BITS, "0")
    rest = F.greatest(depth - KEY_BITS, F.lit(0))
    return F.concat(F.substring(first, KEY_BITS + 1 - key, key), F.substring(more, KEY_BITS + 1 - rest, rest))


def directory(rows: DataFrame, limit: int, start: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """For prefixes of ``depth`` bits under prefixes of ``start`` bits that are too large: those whose shard
    is found (p, shard, shard_bytes, shard_rows, depth), and those that must be split further (p)."""
    sizes = stage(rows.groupBy(_prefix(depth).alias("p")).agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")),
                  "shard-sizes")
    # every prefix at every depth up to its own: a few rows a shard, whatever the number of rows
    every = sizes.select("p", "bytes", "rows", F.explode(F.sequence(F.lit(start), F.lit(depth))).alias("depth"))
    every = every.withColumn("q", _shorten(depth, F.col("depth")))
    fits = (every.groupBy("depth", "q").agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
            .where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1)))
    own = every.select("p", "depth", "q").join(fits, ["depth", "q"])
    first = own.groupBy("p").agg(F.min_by(F.struct("q", "shard_bytes", "shard_rows", "depth"), "depth").alias("x"))
    found = stage(first.select("p", _name("x.q", F.col("x.depth")).alias("shard"), "x.shard_bytes", "x.shard_rows", "x.depth"),
                  "shard-directory")
    return found, sizes.select("p").join(found.select("p"), "p", "left_anti")


def assign_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per row: key, n_bytes, shard (the prefix's bits), depth, shard_rows, shard_bytes, oversize."""
    need(docs, key, text)
    rows = docs.select(col(key).alias("key"), F.coalesce(F.octet_length(col(text).cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
                       key_bits(col(key)).alias("h1"), F.monotonically_increasing_id().alias("place"))
    rows = stage(rows, "shard-rows")
    rows = rows.withColumn("h2", F.shiftrightunsigned(F.xxhash64("place"), 64 - KEY_BITS)).drop("place")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(2 * KEY_BITS, max(1, math.ceil(math.log2(max(1, total / limit)))) + STEP)
    start, out, left = 0, None, rows
    while True:
        found, rest = directory(left, limit, start, depth)
        tagged = left.withColumn("p", _prefix(depth))
        done = tagged.join(found, "p").select("key", "n_bytes", "shard", "depth", "shard_rows", "shard_bytes",
                                              (F.col("shard_bytes") > limit).alias("oversize"))
        out = done if out is None else out.unionByName(done)
        rest = stage(rest, "shard-rest")
        if depth == 2 * KEY_BITS or not rest.limit(1).count():
            return out
        left = stage(tagged.join(rest, "p", "left_semi").drop("p"), "shard-left")
        start, depth = depth + 1, min(2 * KEY_BITS, depth + STEP)


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Write ``docs`` as one folder ``shard=b<bits>`` per shard (keys must be unique) and return the assignment.

    A column of ``docs`` called shard is replaced."""
    given = stage(assign_shards(docs, key, text, limit), "shards")
    k = free_name(docs, "shard_key")
    s = given.select(F.col("key").alias(k), F.concat(F.lit("b"), "shard").alias("shard"))
    named = docs.drop("shard").join(s, col(key).eqNullSafe(col(k))).drop(k)
    named.repartition("shard").write.partitionBy("shard").parquet(path)
    return given
