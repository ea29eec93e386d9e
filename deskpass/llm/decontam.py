"""Benchmark decontamination by template canonicalisation (DataFrame functions only).

A text's words (runs of letters and digits) become template tokens: words that start
with a digit become a number slot, units of measure a unit slot, capitalised words a
name slot, all others their lower case. Windows of ``WORDS`` template tokens with at
least ``LITERALS`` literal ones are hashed; document windows meet benchmark windows
in one hash join, so an item is found again when its numbers, names or units were
exchanged. Slots are then checked: along one alignment (document position minus item
position), each item value must stand for one document value, the commonest; windows
that disagree don't count. A document is contaminated by an item if at least
``least`` of the item's different windows are matched. Items without usable windows, or
with fewer than ``FEW`` while others were discarded, are also looked for by windows of
their very words (``exact_items``).

The document side is exploded and joined in the task that scans it as long as Spark
finds the benchmark's windows small enough to broadcast, and shuffled by window
otherwise; what goes on after the join is only the matches. Whole texts count.

Defined cases: null and empty texts and items have no windows; an item of fewer than five
words is one window of its words (of characters where a script has no spaces), so an item
of one word is found wherever that word is; equal texts under one id
give one row; documents without an id are judged too; items that share a canonical
text are each reported; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskpass.llm.common import col, free_name, need, stage

WORDS = 5
LITERALS = 3
LEAST = 0.8
FEW = 3  # items with fewer different usable windows, while others were discarded, are looked for word by word too
WORD_PATTERN = r"[\p{L}\p{N}]+"
# Scripts written without spaces, whose words are characters in exact windows.
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
EXACT_PATTERN = rf"[{_UNSPACED}&&[\p{{L}}\p{{N}}]]|[\p{{L}}\p{{N}}&&[^{_UNSPACED}]]+"
# Units of measure taken for each other.
UNITS = ["mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles",
         "mg", "g", "kg", "gram", "grams", "pound", "pounds", "ounce", "ounces", "ton", "tons",
         "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons",
         "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks",
         "month", "months", "year", "years", "cent", "cents", "dollar", "dollars", "euro", "euros",
         "percent", "degree", "degrees", "mph", "kmh"]


def _slot(word: Column) -> Column:
    """1 number, 2 unit, 3 name, null for a literal."""
    first = F.substring(word, 1, 1)
    return (F.when(first.rlike(r"\p{N}"), 1).when(F.lower(word).isin(UNITS), 2)
            .when(first != F.lower(first), 3))


def windows(df: DataFrame, keys: list[Column], text: str) -> DataFrame:
    """``keys``, ``at`` (position from 0), ``w`` (window hash) and for each of its words the value hash
    v0.. and whether it is a slot s0.., one row per usable window."""
    words = F.regexp_extract_all(col(text).cast("string"), F.lit(WORD_PATTERN), F.lit(0))
    token = lambda t: F.struct(
        F.xxhash64(F.lower(t)).alias("v"), F.coalesce(_slot(t), F.lit(0)).cast("tinyint").alias("s"))
    base = df.select(*keys, F.transform(words, token).alias("t"))
    values, slots = F.col("t.v"), F.col("t.s")
    base = base.select(*[c for c in base.columns if c != "t"], values.alias("v"), slots.alias("s")).where(F.size("v") >= WORDS)
    n = F.size("v") - (WORDS - 1)
    part = lambda a, i: F.slice(a, F.lit(i + 1), n)
    zipped = F.arrays_zip(*[part("v", i).alias(f"v{i}") for i in range(WORDS)], *[part("s", i).alias(f"s{i}") for i in range(WORDS)])
    rows = base.select(*[c for c in base.columns if c not in ("v", "s")], F.posexplode(zipped).alias("at", "x"))
    x = lambda i, k: F.col("x").getField(f"{k}{i}")
    literals = sum((F.when(x(i, "s") == 0, 1).otherwise(0) for i in range(WORDS)), F.lit(0))
    template = F.xxhash64(*[F.when(x(i, "s") == 0, x(i, "v")).otherwise(x(i, "s").cast("long")) for i in range(WORDS)])
    return rows.where(literals >= LITERALS).select(
        *[c for c in rows.columns if c not in ("x",)], template.alias("w"),
        *[x(i, "v").alias(f"v{i}") for i in range(WORDS)], *[x(i, "s").alias(f"s{i}") for i in range(WORDS)])


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, w, at, n_windows, values, slots): the first occurrence of each different window of every item."""
    need(benchmark, item_col, text)
    it = windows(benchmark, [col(item_col).alias("item_id"), F.xxhash64(col(text).cast("string")).alias("item_hash")], text)
    first = it.withColumn("nth", F.row_number().over(Window.partitionBy("item_id", "item_hash", "w").orderBy("at"))).where("nth = 1")
    return first.select(
        "item_id", "item_hash", "w", F.col("at").alias("item_at"),
        F.count(F.lit(1)).over(Window.partitionBy("item_id", "item_hash")).alias("n_windows"),
        F.array(*[F.when(F.col(f"s{i}") > 0, F.col(f"v{i}")) for i in range(WORDS)]).alias("item_values"))


def _exact_words(text: str) -> Column:
    """Hashes of a text's words in lower case, characters where a script has no spaces."""
    words = F.regexp_extract_all(col(text).cast("string"), F.lit(EXACT_PATTERN), F.lit(0))
    return F.transform(words, lambda t: F.xxhash64(F.lower(t)))


def _exact_windows(v: Column, size: Column) -> Column:
    """Hashes of the different windows of ``size`` words (null size or fewer words: none)."""
    at = F.when((size > 0) & (F.size(v) >= size), F.sequence(F.lit(0), F.size(v) - size)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.slice(v, i + 1, size))))


def exact_items(benchmark: DataFrame, item_col: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, item_hash, size, w, n_windows): windows of the very words of items without enough template
    windows, of ``WORDS`` words or, in shorter items, of all."""
    need(benchmark, item_col, text)
    key = [col(item_col).alias("item_id"), F.xxhash64(col(text).cast("string")).alias("item_hash")]
    words = F.regexp_extract_all(col(text).cast("string"), F.lit(WORD_PATTERN), F.lit(0))
    items = benchmark.where(col(text).isNotNull()).select(*key, F.size(words).alias("n_words"), _exact_words(text).alias("v")).dropDuplicates(
        ["item_id", "item_hash"])
    usable = (windows(benchmark, key, text).groupBy("item_id", "item_hash")
              .agg(F.countDistinct("w").alias("different"), F.countDistinct("at").alias("places"))
              .select(F.col("item_id").alias("u_id"), F.col("item_hash").alias("u_hash"), "different", "places"))
    j = items.join(usable, F.col("item_id").eqNullSafe(F.col("u_id")) & (F.col("item_hash") == F.col("u_hash")), "left")
    places = F.coalesce("places", F.lit(0))
    weak = (places == 0) | (F.col("different") < FEW) & (places < F.col("n_words") - (WORDS - 1))
    j = j.where(weak & (F.size("v") > 0)).withColumn("size", F.least(F.lit(WORDS), F.size("v")))
    j = j.withColumn("ws", _exact_windows(F.col("v"), F.col("size")))
    return j.select("item_id", "item_hash", "size", F.explode("ws").alias("w"), F.size("ws").alias("n_windows"))


def _exact_hits(docs: DataFrame, items: DataFrame, id_col: str, text: str, least: float) -> DataFrame:
    """As ``contaminated``, by the exact windows ``items``."""
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most WORDS
    body = F.coalesce(col(text).cast("string"), F.lit(""))
    base = docs.select(col(id_col).alias("doc_id"), F.xxhash64(body).alias("text_hash"), _exact_words(text).alias("v"))

    def sized(k: int) -> Column:
        return F.transform(_exact_windows(F.col("v"), F.lit(k)), lambda w: F.struct(F.lit(k).alias("size"), w.alias("w")))

    every = F.concat(*map(sized, sizes))
    own = base.select("doc_id", "text_hash", F.explode(every).alias("x")).select("doc_id", "text_hash", "x.*")
    return (own.join(items, ["size", "w"]).groupBy("doc_id", "text_hash", "item_id", "item_hash")
            .agg(F.first("n_windows").cast("long").alias("n_windows"), F.countDistinct("w").alias("n_matched"))
            .where(F.col("n_matched") >= least * F.col("n_windows"))
            .select("doc_id", "text_hash", "item_id", "n_windows", "n_matched",
                    F.round(F.col("n_matched") / F.col("n_windows"), 6).alias("coverage")).distinct())


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text",
                 item_col: str = "item_id", item_text: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, text_hash, item_id, n_windows, n_matched, coverage) of every document and item that it contains."""
    need(docs, id_col, text)
    items = stage(benchmark_windows(benchmark, item_col, item_text), "decontam-items")
    body = F.coalesce(col(text).cast("string"), F.lit(""))
    own = windows(docs, [col(id_col).alias("doc_id"), F.xxhash64(body).alias("text_hash")], text)
    values = F.array(*[F.col(f"v{i}") for i in range(WORDS)])
    hits = (own.join(items, "w")
            .select("doc_id", "text_hash", "item_id", "item_hash", "n_windows", "item_at", "at",
                    F.when(F.exists("item_values", lambda v: v.isNotNull()), F.arrays_zip(
                        F.col("item_values").alias("mine"), values.alias("theirs"))).alias("slots"))
            .distinct())
    hits = stage(hits, "decontam-hits")
    who = ["doc_id", "text_hash", "item_id", "item_hash"]
    # items with too few matched windows, whatever their slots, go first
    enough = F.countDistinct("item_at") >= least * F.first("n_windows")
    likely = hits.groupBy(*who).agg(enough.alias("ok")).where("ok").select(*[F.col(c).alias(f"l_{c}") for c in who])
    same = lambda a, b: (F.col(f"{a}doc_id").eqNullSafe(F.col(f"{b}doc_id")) & (F.col(f"{a}text_hash") == F.col(f"{b}text_hash"))
                         & F.col(f"{a}item_id").eqNullSafe(F.col(f"{b}item_id")) & F.col(f"{a}item_hash").eqNullSafe(F.col(f"{b}item_hash")))
    hits = stage(hits.join(likely, same("", "l_"), "left_semi"), "decontam-likely")
    line = [*who, (F.col("at") - F.col("item_at")).alias("shift")]
    slots = (hits.where("slots is not null").select(*line, "item_at", F.posexplode("slots").alias("k", "x"))
             .where("x.mine is not null")
             .select(*who, "shift", F.col("item_at"), (F.col("item_at") + F.col("k")).alias("place"),
                     F.col("x.mine").alias("mine"), F.col("x.theirs").alias("theirs")))
    votes = (slots.select(*who, "shift", "place", "mine", "theirs").distinct()
             .groupBy(*who, "shift", "mine", "theirs").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")))
    usual = (votes.groupBy(*who, "shift", "mine")
             .agg(F.max_by("theirs", F.struct(F.col("n"), -F.col("first"))).alias("usual")))
    u = usual.select(*[F.col(c).alias(f"u_{c}") for c in [*who, "shift", "mine"]], "usual")
    odd = (slots.join(u, same("", "u_") & (F.col("shift") == F.col("u_shift")) & (F.col("mine") == F.col("u_mine")))
           .where(F.col("theirs") != F.col("usual")).select(*who, "shift", "item_at").distinct())
    o = odd.select(*[F.col(c).alias(f"o_{c}") for c in odd.columns])
    good = hits.withColumn("shift", F.col("at") - F.col("item_at")).join(
        o, same("", "o_") & (F.col("shift") == F.col("o_shift")) & (F.col("item_at") == F.col("o_item_at")), "left_anti")
    found = (good.groupBy(*who).agg(F.first("n_windows").alias("n_windows"), F.countDistinct("item_at").alias("n_matched"))
            .where(F.col("n_matched") >= least * F.col("n_windows"))
            .select("doc_id", "text_hash", "item_id", F.col("n_windows").cast("long").alias("n_windows"), "n_matched",
                    F.round(F.col("n_matched") / F.col("n_windows"), 6).alias("coverage")).distinct())
    exact = stage(exact_items(benchmark, item_col, item_text), "decontam-exact")
    if not exact.limit(1).count():
        return found
    found = stage(found, "decontam-found")
    f = found.select(*[F.col(c).alias(f"f_{c}") for c in ("doc_id", "text_hash", "item_id")])
    more = _exact_hits(docs, exact, id_col, text, least).join(
        f, F.col("doc_id").eqNullSafe(F.col("f_doc_id")) & (F.col("text_hash") == F.col("f_text_hash"))
        & F.col("item_id").eqNullSafe(F.col("f_item_id")), "left_anti")
    return found.unionByName(more)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that contain an item of ``benchmark``."""
    bad_id, bad_hash = free_name(docs, "bad_id"), free_name(docs, "bad_hash")
    bad = contaminated(docs, benchmark, id_col, text, **options).select(
        F.col("doc_id").alias(bad_id), F.col("text_hash").alias(bad_hash)).distinct()
    bad = stage(bad, "decontam-bad")
    h = free_name(docs, "text_hash")
    names = [col(c) for c in docs.columns]
    j = docs.withColumn(h, F.xxhash64(F.coalesce(col(text).cast("string"), F.lit(""))))
    return j.join(bad, col(id_col).eqNullSafe(col(bad_id)) & (col(h) == col(bad_hash)), "left_anti").select(*names)
