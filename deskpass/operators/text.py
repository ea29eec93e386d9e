"""Chunking and TF-IDF.

TF-IDF is kept in long form ``(doc, term, weight)``: term counts combine
map-side per (doc, term); document frequency is a count over that table;
the idf join is a plain equi-join that AQE may broadcast (small vocabulary)
or split where a very common term makes one partition large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deskpass.functions.text import tokens
from deskpass.schema import CHUNK_OVERLAP, CHUNK_SIZE


def chunk_windows(df: DataFrame, text: str = "text", size: int = CHUNK_SIZE,
                  overlap: int = CHUNK_OVERLAP, out: str = "chunk") -> DataFrame:
    """Fixed windows of ``size`` characters, each starting ``size - overlap`` after the last.

    Starts run 1, 1+step, … while <= max(1, length - overlap), so the windows
    cover the whole text. Adds ``chunk_no`` (0-based), ``start`` (1-based) and ``out``.

    Linear in the text length: one regex pass cuts the text into ``step``-
    character pieces, and window j is pieces j … j+m-1 plus the head of the
    next piece. (``substring`` at a character offset walks the UTF-8 bytes
    from the start each time, which makes per-window substrings quadratic —
    minutes for a multi-megabyte text.)
    """
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    step = size - overlap
    m, r = divmod(size, step)
    t = F.col(text)
    last = F.floor((F.greatest(F.lit(1), F.char_length(t) - overlap) - 1) / step)
    pieces = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    d = df.select("*", pieces.alias("__pieces"))
    d = d.select("*", F.posexplode(F.sequence(F.lit(0), last)).alias("chunk_no", "__j"))
    body = F.array_join(F.slice("__pieces", F.col("__j") + 1, F.lit(m)), "")
    if r:
        head = F.substring(F.get("__pieces", F.col("__j") + m), 1, r)
        body = F.concat(body, F.coalesce(head, F.lit("")))
    return (d.withColumn("start", (F.col("__j") * step + 1).cast("int"))
            .withColumn(out, body).drop("__pieces", "__j"))


# --- T2: separator-aware splitting -----------------------------------------

def _body_pattern(longest: int) -> str:
    """At most ``longest`` characters: the rest of the text if it fits, else up to the last
    paragraph break, else the last line break, else the last white space, else a plain cut."""
    run = rf".{{0,{longest - 1}}}\S"
    return (rf"(?s).{{1,{longest}}}\z|{run}(?=[^\S\n]{{0,8}}\n\n)|{run}(?=[^\S\n]{{0,8}}\n)|{run}(?=\s)"
            rf"|.{{1,{longest}}}")


def chunk_separators(df: DataFrame, text: str = "text", size: int = CHUNK_SIZE,
                     overlap: int = CHUNK_OVERLAP, out: str = "chunk") -> DataFrame:
    """One row per separator-aware chunk with ``chunk_no``.

    One regex pass cuts the text into bodies of at most ``size - overlap`` characters,
    each at the best break within reach; together they are the text. A chunk is a body
    after the last whole words of the body before it (at most ``overlap`` characters),
    without white space at its ends, so no chunk is longer than ``size``. Null and
    blank texts have no chunks."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than the chunk size")
    bodies = F.regexp_extract_all(F.col(text), F.lit(_body_pattern(size - overlap)), F.lit(0))
    bodies = F.filter(bodies, lambda b: b.rlike(r"\S"))
    d = df.select("*", bodies.alias("__bodies")).select("*", F.posexplode("__bodies").alias("chunk_no", "__body"))
    before = F.get("__bodies", F.col("chunk_no") - 1)
    tail = F.regexp_extract(before, rf"(?s)\s(\S.{{0,{overlap - 1}}})\z", 1) if overlap else F.lit("")
    chunk = F.regexp_replace(F.concat(F.coalesce(tail, F.lit("")), "__body"), r"^\s+|\s+$", "")
    return d.withColumn(out, chunk).drop("__body", "__bodies")


# --- T3/T4/A11: TF-IDF in long form -----------------------------------------

def term_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf): raw counts of each token per document."""
    return (docs.select(key, F.explode(tokens(text)).alias("term"))
            .groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf")))


def idf_table(tf: DataFrame, n_docs: int) -> DataFrame:
    """(term, df, idf) with smoothed idf = ln((1+n)/(1+df)) + 1."""
    # Documents in which the term occurs. Written over ``tf`` (not count(*)) so this
    # branch keeps the same plan as the tf branch and Spark reuses one
    # tokenise-and-count exchange for both instead of tokenising twice.
    df = tf.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    return df.withColumn("idf", F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0)


def weigh(tf: DataFrame, idf: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term, weight): tf × idf, L2-normalised per document; unknown terms drop out."""
    raw = tf.join(idf.select("term", "idf"), "term", "inner").withColumn("__w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("__w") * F.col("__w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("__w") / norm).alias("weight"))


def fit_idf(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fit the vocabulary and idf on ``docs`` (one count job for the document total)."""
    n = docs.count()
    return idf_table(term_counts(docs, key, text), n)


def tfidf(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fit and apply in one go."""
    n = docs.count()
    tf = term_counts(docs, key, text)
    return weigh(tf, idf_table(tf, n), key)


def apply_idf(docs: DataFrame, idf: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """T4: weigh new documents with a fitted vocabulary."""
    return weigh(term_counts(docs, key, text), idf, key)
