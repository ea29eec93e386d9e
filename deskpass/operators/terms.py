"""Lookup of many terms in many texts (R6): a term table joined to the text's own pieces.

A term occurs in a text where one of the text's substrings equals it, whatever stands around it. With
one search per term, work is texts x terms; here it is one pass per text, whatever the number of terms:

1. Every term has an anchor, its first ``ANCHORS`` characters (a shorter term is its own anchor): the most
   characters at which the table of anchors, each with the lengths of its terms, provably fits
   (``AUTOMATON_BYTES``). However many terms share an anchor, it is one row of that table.
2. One scan of the texts finds the places of the anchors, by an Aho-Corasick automaton that every Python
   worker builds once from the broadcast anchors. There the substrings of its terms' lengths are cut out,
   each once per stretch.
3. These substrings are joined to the terms by an equi-join, broadcast or shuffled as Spark finds by size:
   what is shuffled are the substrings that begin like a term, never the text.

A text is cut into stretches of ``STRETCH`` characters before that, each with as much of what follows as
the longest term needs, so one long text is many rows. Where the whole table is small and provably fits
(``AUTOMATON_BYTES``), the automaton holds the terms themselves and there is no join; both forms give the
same rows.

Defined cases: null texts and null or empty terms match nothing; repeated terms and texts count once per
(id, label); matching is by code points, without folding; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

ANCHORS = (8, 4, 2, 1)  # characters of an anchor, the most that fit
STRETCH = 2000
AUTOMATON_BYTES = 16 << 20


def _clean(terms: DataFrame, term: str, label: str) -> DataFrame:
    t = terms.select(F.col(term).cast("string").alias("term"), F.col(label).alias("label"))
    return t.where("term is not null and term <> ''").distinct()


def stretches(texts: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """(key, text) with every text cut into stretches of ``size`` characters and ``overlap`` more of what follows."""
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    d = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), pieces.alias("p"))
    more = (overlap + size - 1) // size  # whole pieces that the overlap can reach into
    d = d.select("key", "p", F.posexplode("p").alias("i", "head"))
    tail = F.substring(F.array_join(F.slice("p", F.col("i") + 2, F.lit(more)), ""), 1, overlap)
    return d.select("key", F.concat("head", F.when(F.col("i") + 1 < F.size("p"), tail).otherwise("")).alias("stretch"))


def _anchors(terms: DataFrame, most_bytes: int) -> list[Row]:
    """(anchor, lengths of its terms): the longest anchors that provably fit; those of one character at worst."""
    for n in ANCHORS:
        heads = terms.groupBy(F.substring("term", 1, n).alias("anchor")).agg(F.collect_set(F.char_length("term")).alias("lengths"))
        size = heads.agg(F.sum(F.octet_length("anchor") + 4 * F.size("lengths")).alias("n")).first().n or 0
        if size <= most_bytes or n == ANCHORS[-1]:
            return heads.collect()
    return []


def _cut(held: DataFrame, anchors: list[Row]) -> DataFrame:
    """(key, cut): the substrings of a stretch that begin with an anchor and have a length of its terms, each once."""
    shared = held.sparkSession.sparkContext.broadcast({r.anchor: sorted(r.lengths) for r in anchors})
    schema = held.select("key").schema.add("cut", "string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick
        machine = ahocorasick.Automaton()
        for x, lengths in shared.value.items():
            machine.add_word(x, (len(x), lengths))
        machine.make_automaton()
        for f in frames:
            keys, cuts = [], []
            for k, t in zip(f["key"], f["stretch"]):
                found = {t[a:a + n] for end, (own, lengths) in machine.iter(t) for a in (end + 1 - own,) for n in lengths if a + n <= len(t)}
                keys += [k] * len(found)
                cuts += found
                if len(cuts) >= 1 << 16:
                    yield pd.DataFrame({"key": pd.Series(keys, dtype=f["key"].dtype), "cut": cuts})
                    keys, cuts = [], []
            if cuts:
                yield pd.DataFrame({"key": pd.Series(keys, dtype=f["key"].dtype), "cut": cuts})

    return held.select("key", "stretch").mapInPandas(run, schema)


def joined_matches(texts: DataFrame, terms: DataFrame, key: str = "id", text: str = "text", term: str = "term", label: str = "label",
                   stretch: int = STRETCH, anchor_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """(key, label): the labels of the terms that a text contains, by joining substrings to terms."""
    t = _clean(terms, term, label)
    longest = t.agg(F.max(F.char_length("term")).alias("n")).first().n
    if longest is None:
        return texts.select(F.col(key).alias("key")).join(t.select("label").limit(0), F.lit(False))
    cut = _cut(stretches(texts, key, text, stretch, longest - 1), _anchors(t, anchor_bytes))
    return cut.join(t, F.col("cut") == F.col("term")).select("key", "label").distinct()


def scanned_matches(texts: DataFrame, terms: DataFrame, key: str = "id", text: str = "text", term: str = "term", label: str = "label") -> DataFrame:
    """The same by an automaton of the whole table in every Python worker: one scan, no shuffle but for repeated ids."""
    spark = texts.sparkSession
    t = _clean(terms, term, label)
    schema = texts.select(F.col(key).alias("key")).schema.add("label", t.schema["label"].dataType)
    by_term: dict[str, list] = {}
    for r in t.collect():  # bounded by AUTOMATON_BYTES: see term_matches
        by_term.setdefault(r.term, []).append(r.label)
    shared = spark.sparkContext.broadcast(by_term)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick
        machine = ahocorasick.Automaton()
        for x, labels in shared.value.items():
            machine.add_word(x, labels)
        if len(machine):
            machine.make_automaton()
        for f in frames if len(machine) else ():
            found = [(k, x) for k, t in zip(f["key"], f["text"]) for x in dict.fromkeys(x for _, own in machine.iter(t) for x in own)]
            if found:
                yield pd.DataFrame({"key": [k for k, _ in found], "label": pd.Series([x for _, x in found], dtype=object)})

    narrow = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return narrow.mapInPandas(run, schema).distinct()


def term_matches(texts: DataFrame, terms: DataFrame, key: str = "id", text: str = "text", term: str = "term", label: str = "label",
                 automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """(key, label): the labels of the terms that a text contains; one pass per text whatever the number of terms."""
    size = _clean(terms, term, label).agg(F.sum(F.octet_length("term") + F.octet_length(F.col("label").cast("string"))).alias("n")).first().n
    form = scanned_matches if (size or 0) <= automaton_bytes else joined_matches
    return form(texts, terms, key, text, term, label)


def match_flags(texts: DataFrame, terms: DataFrame, labels: list[str], key: str = "id", text: str = "text", automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """(key, one boolean a label): whether a text contains a term of that label; null for a null text."""
    found = term_matches(texts, terms, key, text, automaton_bytes=automaton_bytes).groupBy("key").agg(F.collect_set("label").alias("found"))
    found = found.withColumnRenamed("key", "f_key")
    j = texts.select(F.col(key).alias("key"), F.col(text).isNull().alias("none")).join(found, F.col("key").eqNullSafe(F.col("f_key")), "left")
    has = lambda x: F.when(~F.col("none"), F.coalesce(F.array_contains("found", x), F.lit(False))).alias(x)
    return j.select("key", *map(has, labels))
