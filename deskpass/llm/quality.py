"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each document gets counts (one Python pass over whole texts, no shuffle of
text). Ratios of these are summarised per (language, source) in a relative-error
quantile sketch: a value falls into the bucket ``ceil(log_gamma(value))`` and the
sketch is the bucket counts, so sketches merge by adding counts, partial
aggregation combines them map-side (a hot source costs one row per bucket and
task), and the result does not depend on the order of rows. Thresholds are
fences around the sketch's quartiles, joined back to the counts.

Defined cases: null text counts as the empty text; null language or source is a
group of its own; a group with fewer than ``min_rows`` usable documents takes its
language's sketch and then that of all documents (sketches merged, nothing
dropped); repeated rows are judged one by one; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskpass.llm.common import bounded_batches, col, free_name, need, stage

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

GAMMA = 1.02          # bucket ratio of the sketch: quantiles are right to about 1 %
MIN_ROWS = 100        # below this a group takes its parent's merged sketch
FENCE = 3.0           # quartile distances beyond the quartile
# Feature: (lower fence?, upper fence?, slack added to a fence so that a group
# without spread does not reject what differs by next to nothing).
FEATURES = {
    "symbols_per_word": (False, True, 0.1),
    "chars_per_word": (True, True, 1.0),
    "dup_line_share": (False, True, 0.4),
}

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def text_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, words in repeated 8-word windows, lines with a word)."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeats = 0
    if n >= WINDOW:
        # words hold no space, so joined windows are equal only if the words are
        windows = [b" ".join(words[i:i + WINDOW]) for i in range(n - WINDOW + 1)]
        seen = Counter(windows)
        if len(seen) < len(windows):
            covered = 0
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeats += i + WINDOW - max(covered, i)
                    covered = i + WINDOW
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, len(lines)


def count_columns(docs: DataFrame, keep: list[Column], text: str = "text") -> DataFrame:
    """``keep`` columns plus the six counts of every row's whole text."""
    bounded_batches(docs.sparkSession)
    narrow = docs.select(*keep, col(text).cast("string").alias("__text"))
    schema = narrow.drop("__text").schema
    for c in COUNTS:
        schema = schema.add(c, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("__text")
            got = [text_counts(t.as_py()) for t in b.column(at)]
            cols = [b.column(i) for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                cols + [pa.array([g[i] for g in got], pa.int64()) for i in range(len(COUNTS))],
                [f for i, f in enumerate(b.schema.names) if i != at] + COUNTS)

    return narrow.mapInArrow(run, schema)


def _features() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "chars_per_word": F.col("word_chars") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def sketch(counts: DataFrame, gamma: float = GAMMA) -> DataFrame:
    """(g_lang, g_source, feature, bucket, n): one mergeable sketch per language, source and feature.

    Bucket null holds zeros; others hold ``gamma^(bucket-1) < value <= gamma^bucket``."""
    feats = F.array(*[F.struct(F.lit(k).alias("feature"), v.alias("value")) for k, v in _features().items()])
    long = counts.where(~F.col("base_failed")).select("g_lang", "g_source", F.explode(feats).alias("f"))
    bucket = F.when(F.col("f.value") > 0, F.ceil(F.log(F.col("f.value")) / F.log(F.lit(gamma))).cast("int"))
    return (long.select("g_lang", "g_source", F.col("f.feature").alias("feature"), bucket.alias("bucket"))
            .groupBy("g_lang", "g_source", "feature", "bucket").agg(F.count(F.lit(1)).alias("n")))


def _quartiles(sk: DataFrame, keys: list[str], gamma: float) -> DataFrame:
    """Quartiles per group from merged bucket counts (windows over buckets, never over documents)."""
    merged = sk.groupBy(*keys, "feature", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "feature")
    run = merged.withColumn("total", F.sum("n").over(w)).withColumn(
        "upto", F.sum("n").over(w.orderBy(F.asc_nulls_first("bucket"))))
    value = F.when(F.col("bucket").isNull(), F.lit(0.0)).otherwise(
        2 * F.pow(F.lit(gamma), F.col("bucket")) / (1 + gamma))
    # the first bucket whose running count reaches the rank
    q = lambda p: F.min(F.when(F.col("upto") >= F.ceil(p * F.col("total")), value))
    return run.groupBy(*keys, "feature").agg(F.max("total").alias("n"), q(0.25).alias("q25"), q(0.75).alias("q75"))


def thresholds(sk: DataFrame, groups: DataFrame, min_rows: int = MIN_ROWS, gamma: float = GAMMA) -> DataFrame:
    """One row per group of ``groups``: lower and upper fence of every feature.

    Groups with too few rows fall back to the sketch merged over their language,
    then to that merged over everything; without any row there is no fence."""
    feats = F.array(*[F.lit(f) for f in FEATURES])
    want = groups.select("g_lang", "g_source").distinct().select("*", F.explode(feats).alias("feature"))
    own = _quartiles(sk, ["g_lang", "g_source"], gamma)
    lang = _quartiles(sk, ["g_lang"], gamma)
    every = _quartiles(sk, [], gamma)
    cols = lambda df, p: [F.col(c).alias(f"{p}_{c}") for c in ("n", "q25", "q75")]
    o = own.select(F.col("g_lang").alias("ol"), F.col("g_source").alias("os"), F.col("feature").alias("of"), *cols(own, "o"))
    l = lang.select(F.col("g_lang").alias("ll"), F.col("feature").alias("lf"), *cols(lang, "l"))  # noqa: E741
    e = every.select(F.col("feature").alias("ef"), *cols(every, "e"))
    j = (want.join(o, F.col("g_lang").eqNullSafe(F.col("ol")) & F.col("g_source").eqNullSafe(F.col("os")) & (F.col("feature") == F.col("of")), "left")
         .join(l, F.col("g_lang").eqNullSafe(F.col("ll")) & (F.col("feature") == F.col("lf")), "left")
         .join(e, F.col("feature") == F.col("ef"), "left"))
    pick = lambda c: (F.when(F.col("o_n") >= min_rows, F.col(f"o_{c}"))
                      .when(F.col("l_n") >= min_rows, F.col(f"l_{c}")).otherwise(F.col(f"e_{c}")))
    j = j.select("g_lang", "g_source", "feature", pick("q25").alias("q25"), pick("q75").alias("q75"))
    reach = FENCE * (F.col("q75") - F.col("q25"))
    one = lambda f, e: F.max(F.when(F.col("feature") == f, e))
    out = []
    for f, (low, high, slack) in FEATURES.items():
        out.append((one(f, F.col("q25") - reach - slack) if low else F.max(F.lit(None).cast("double"))).alias(f"low_{f}"))
        out.append((one(f, F.col("q75") + reach + slack) if high else F.max(F.lit(None).cast("double"))).alias(f"high_{f}"))
    return j.groupBy("g_lang", "g_source").agg(*out)


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
                     source: str = "source", min_rows: int = MIN_ROWS, gamma: float = GAMMA) -> DataFrame:
    """One row per document: id, counts, ``base_failed`` and ``kept``, with the fences that judged it.

    ``base_failed``: under 20 words, or over 30 % of the words in repeated 8-word
    windows. Others are kept if every ratio lies inside its group's fences."""
    need(docs, id_col, text, lang, source)
    counts = count_columns(docs, [col(id_col).alias("g_id"), col(lang).alias("g_lang"), col(source).alias("g_source")], text)
    counts = stage(counts.withColumn("base_failed", base_failed()), "quality-counts")
    sk = stage(sketch(counts, gamma), "quality-sketch")
    limits = stage(thresholds(sk, counts, min_rows, gamma), "quality-limits")
    lim = limits.withColumnRenamed("g_lang", "t_lang").withColumnRenamed("g_source", "t_source")
    j = counts.join(lim, F.col("g_lang").eqNullSafe(F.col("t_lang")) & F.col("g_source").eqNullSafe(F.col("t_source")), "left")
    inside = F.lit(True)
    for f, v in _features().items():
        inside = inside & F.coalesce(v >= F.col(f"low_{f}"), F.lit(True)) & F.coalesce(v <= F.col(f"high_{f}"), F.lit(True))
    fences = [F.round(F.col(f"{side}_{f}"), 6).alias(f"{side}_{f}") for f, (lo, hi, _) in FEATURES.items()
              for side, on in (("low", lo), ("high", hi)) if on]
    return j.select(F.col("g_id").alias("doc_id"), *COUNTS[:5], "base_failed",
                    (~F.col("base_failed") & inside).alias("kept"), *fences)


def quality_filter(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose document is kept. Ids must be unique (rows with a null id go)."""
    k = free_name(docs, "kept_id")
    kept = quality_verdicts(docs, id_col=id_col, **options).where("kept").select(F.col("doc_id").alias(k))
    return docs.join(kept, col(id_col) == col(k), "left_semi")
