"""Source divergence audit by sparse merges of pair tasks.

Within a language every source's use of words is held against that of every other source, and
against the whole language. A group's smoothed share of a term is p = 1 + floor(10^9 (count + 1)
/ (N + V)), over the V terms that at least ``LEAST_DOCS`` of the language's documents have (N: the
group's occurrences of them); the divergence of p from another share q is floor((p - q)^2 / q),
summed over all V terms.

Terms are counted per task before they are shuffled (a text's words are never rows). The kept
terms of a language are dealt by hash into slices of about ``SLICE`` terms and numbered within
their slice, and each group has one array of sorted term numbers with its shares per slice. A
pair task brings the arrays of two groups of one slice together (a join on language and slice),
finds the common terms by galloping (binary search of the shorter array's numbers in the longer
one), and prices them, the terms that only one of the two has and those that neither has, both
ways at once: a pair's slices are separate tasks, so neither a group's vocabulary nor a frequent
source lands in one task, and the sums of slices are added up afterwards. Tasks are one per
unordered pair and slice: the result has a row for every ordered pair, so they grow as it does.

All arithmetic is exact: counts and shares in decimals and 64-bit integers (a share is at most
10^9 + 1, so a square and a sum of divergences, which is at most (10^9 + V)^2, fit).

Defined cases: null text, language and source are empty ones; a row is a document, repeated or
not, whatever its id; a group without kept terms has the share floor for every term; a language
without kept terms diverges by 0; a language of one source has no pairs; an empty table gives no
rows; further columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskpass.llm.common import bounded_batches, col, need, stage

SCALE = 1_000_000_000
LEAST_DOCS = 3
SLICE = 4096      # terms of a slice, about
TOP = 200         # ranks of a group's terms that are reported
HELD = 400_000    # distinct (group, term) of a Python task before they are sent on
AT_ONCE = 1 << 22  # bytes of a text whose words are listed at once

# Letters in lower case and all bytes beyond ASCII stay, everything else is a space.
_FOLD = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms_of(text: str | None) -> Counter:
    """Occurrences of every term of a text, as UTF-8: runs of letters and of what lies beyond ASCII, A-Z in lower case."""
    raw = (text or "").encode("utf-8", "replace").translate(_FOLD)
    if len(raw) <= AT_ONCE:
        return Counter(raw.split())
    out, at = Counter(), 0
    while at < len(raw):
        end = raw.find(b" ", at + AT_ONCE)
        end = len(raw) if end < 0 else end
        out.update(raw[at:end].split())
        at = end
    return out


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of a term in a group, summed over a task's rows or less."""
    need(docs, text, lang, source)
    bounded_batches(docs.sparkSession)
    narrow = docs.select(*[F.coalesce(col(c).cast("string"), F.lit("")).alias(n)
                           for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    names = ["lang", "source", "term", "n", "docs"]

    def send(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (own_lang, own_source), (n, d) in held.items():
            terms = list(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([own_lang] * len(terms), pa.string()), pa.array([own_source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()),
                 pa.array([n[t] for t in terms], pa.int64()), pa.array([d[t] for t in terms], pa.int64())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for b in batches:
            texts, langs, sources = (b.column(k) for k in range(3))
            for t, *group in zip(texts, langs.to_pylist(), sources.to_pylist()):
                n, d = held.setdefault(tuple(group), (Counter(), Counter()))
                found, before = terms_of(t.as_py()), len(n)
                n.update(found)
                d.update(found.keys())
                size += len(n) - before
                if size > HELD:
                    yield from send(held)
                    held, size = {}, 0
        yield from send(held)

    return narrow.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (total + kept)), exactly."""
    exact = lambda c: c.cast("decimal(19,0)")
    return (F.lit(1) + F.call_function("div", exact(n + 1) * F.lit(SCALE).cast("decimal(10,0)"), exact(total + kept))).cast("long")


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q), of longs."""
    return F.call_function("div", (p - q) * (p - q), q)


class Audit:
    """The written tables of an audit: groups with their totals, and the kept terms that each group has."""

    def __init__(self, docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                 least_docs: int = LEAST_DOCS):
        counted = stage(term_counts(docs, text, lang, source).groupBy("lang", "term", "source")
                        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")
        kept = stage(counted.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
                     .where(F.col("docs") >= least_docs).drop("docs"), "divergence-kept")
        sizes = stage(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
                      .withColumn("slices", F.ceil(F.col("v") / SLICE).cast("int")), "divergence-sizes")
        dealt = kept.join(sizes.select("lang", "slices"), "lang").select(
            "lang", "term", "lang_n", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int").alias("slice"))
        place = Window.partitionBy("lang", "slice").orderBy("term")  # bounded: a slice holds about SLICE terms
        numbered = stage(dealt.withColumn("id", F.row_number().over(place) - 1), "divergence-numbers")
        #: lang, slice, size: the number of terms of every slice
        self.slices = numbered.groupBy("lang", "slice").agg(F.count(F.lit(1)).alias("size"))
        own = stage(counted.drop("docs").join(numbered, ["lang", "term"]), "divergence-own")
        totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = docs.select(*[F.coalesce(col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))])
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        #: lang, source, total, v, lang_total: one row a group, with terms or not
        self.groups = stage(groups.distinct().join(totals, ["lang", "source"], "left").join(sizes.drop("slices"), "lang", "left")
                            .select("lang", "source", *map(zero, ("total", "v", "lang_total"))), "divergence-groups")
        #: lang, source, term, slice, id, p (the group's share), q (the language's)
        self.terms = own.join(self.groups, ["lang", "source"]).select(
            "lang", "source", "term", "slice", "id", share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
            share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"))

    def arrays(self) -> DataFrame:
        """(lang, slice, source, size, p0, ids, shares): every group's terms of a slice in the order of their numbers;
        p0 is the share of a term that the group has not."""
        held = (self.terms.groupBy("lang", "slice", "source").agg(F.array_sort(F.collect_list(F.struct("id", "p"))).alias("x"))
                .select("lang", "slice", "source", F.col("x.id").alias("ids"), F.col("x.p").alias("shares")))
        every = self.groups.join(self.slices, "lang").select(
            "lang", "slice", "source", "size", share(F.lit(0).cast("long"), F.col("total"), F.col("v")).alias("p0"))
        return every.join(held, ["lang", "slice", "source"], "left").select(
            "lang", "slice", "source", "size", "p0", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"),
            F.coalesce("shares", F.array().cast("array<bigint>")).alias("shares"))

    def pairs(self) -> DataFrame:
        """(lang, source, item, value): the divergence of every source from every other source of its language."""
        arrays = stage(self.arrays(), "divergence-arrays")
        side = lambda s: arrays.select("lang", "slice", "size", F.col("source").alias(s),
                                       *[F.col(c).alias(f"{s}_{c}") for c in ("ids", "shares", "p0")])
        merged = price("a_ids", "a_shares", "a_p0", "b_ids", "b_shares", "b_p0", "size")
        tasks = side("a").join(side("b").drop("size"), ["lang", "slice"]).where("a < b").select("lang", "a", "b", merged.alias("x"))
        summed = tasks.groupBy("lang", "a", "b").agg(F.sum("x.ab").alias("ab"), F.sum("x.ba").alias("ba"))
        names = self.groups.select("lang", "source")
        every = (names.select("lang", F.col("source").alias("a")).join(names.select("lang", F.col("source").alias("b")), "lang")
                 .where("a < b").join(summed, ["lang", "a", "b"], "left"))  # languages without kept terms have no slices
        way = lambda x, y, v: F.struct(F.col(x).alias("source"), F.col(y).alias("item"),
                                       F.coalesce(v, F.lit(0)).cast("long").alias("value"))
        return every.select("lang", F.explode(F.array(way("a", "b", "ab"), way("b", "a", "ba"))).alias("x")).select("lang", "x.*")

    def telling_terms(self) -> DataFrame:
        """(lang, source, item, value): terms that a group has more often than its language."""
        return self.terms.where("p > q").select("lang", "source", F.col("term").alias("item"),
                                                divergence(F.col("p"), F.col("q")).alias("value"))


@F.pandas_udf(T.StructType([T.StructField("ab", T.LongType()), T.StructField("ba", T.LongType())]))
def price(a_ids: pd.Series, a_shares: pd.Series, a_p0: pd.Series, b_ids: pd.Series, b_shares: pd.Series, b_p0: pd.Series,
          size: pd.Series) -> pd.DataFrame:
    """A pair task a row: both divergences of two groups' terms of a slice."""
    rows = [merge_prices(*x) for x in zip(a_ids, a_shares, a_p0, b_ids, b_shares, b_p0, size)]
    return pd.DataFrame({"ab": pd.Series([r[0] for r in rows], dtype="int64"), "ba": pd.Series([r[1] for r in rows], dtype="int64")})


def merge_prices(ids_a: np.ndarray, p: np.ndarray, p0: int, ids_b: np.ndarray, q: np.ndarray, q0: int, size: int) -> tuple[int, int]:
    """(sum of f(p, q), sum of f(q, p)) over a slice of ``size`` terms; ids are sorted, p0 and q0 the shares of absent terms."""
    if len(ids_a) > len(ids_b):
        ab, ba = merge_prices(ids_b, q, q0, ids_a, p, p0, size)
        return ba, ab
    at = np.searchsorted(ids_b, ids_a)  # galloping: each of the fewer looks its place up in the more
    common = np.zeros(len(ids_a), bool)
    inside = at < len(ids_b)
    common[inside] = ids_b[at[inside]] == ids_a[inside]
    alone_b = np.ones(len(ids_b), bool)
    alone_b[at[common]] = False
    p, q = p.astype(np.int64), q.astype(np.int64)
    one = lambda x: np.full(len(x), 1, np.int64)
    x = np.concatenate([p, one(q[alone_b]) * p0])
    y = np.concatenate([one(p) * q0, q[alone_b]])
    y[:len(p)][common] = q[at[common]]
    square = (x - y) ** 2
    neither, far = size - len(x), (p0 - q0) ** 2
    return int((square // y).sum()) + neither * (far // q0), int((square // x).sum()) + neither * (far // p0)


def ranked(found: DataFrame, part: str) -> DataFrame:
    w = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return found.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(w).alias("rank"))


def divergence_audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                     top: int = TOP, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` ranks the other sources of the language by their
    divergence, part ``term`` the first ``top`` terms that the source has more often than its language."""
    audit = Audit(docs, text, lang, source, least_docs)
    return ranked(audit.pairs(), "pair").unionByName(ranked(audit.telling_terms(), "term").where(F.col("rank") <= top))
