"""Source divergence audit against a brute-force version and DuckDB."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from deskpass.llm import divergence, queries

LOWER = {c: c + 32 for c in range(65, 91)}
SCALE = 10 ** 9


def terms(text):
    return [w.translate(LOWER) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(rows, top=200, least=3):
    rows = [(t, l or "", s or "") for t, l, s in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == lang]
        seen = Counter(w for t, *_ in own for w in set(terms(t)))
        kept = sorted(w for w, n in seen.items() if n >= least)
        whole, counts = Counter(), {s: Counter() for _, _, s in own}
        for t, _, s in own:
            found = Counter(w for w in terms(t) if seen[w] >= least)
            counts[s].update(found)
            whole.update(found)

        def p(n, w):
            return 1 + SCALE * (n[w] + 1) // (n.total() + len(kept))

        def f(a, b):
            return (a - b) ** 2 // b

        for s, n in counts.items():
            pairs = sorted((-sum(f(p(n, w), p(m, w)) for w in kept), o.encode(), o) for o, m in counts.items() if o != s)
            telling = sorted((-f(p(n, w), p(whole, w)), w.encode(), w) for w in kept if n[w] and p(n, w) > p(whole, w))
            out |= {(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pairs, 1)}
            out |= {(lang, s, "term", o, -v, k) for k, (v, _, o) in enumerate(telling[:top], 1)}
    return out


def fixture():
    rng = random.Random(13)
    words = ["der", "Der", "été", "ÉTÉ", "naïve", "日本", "x1y", "don't", "a-b", "zz", "İ", "_q_"] + [f"{a}{b}" for a in "abcdef" for b in "ghijkl"]
    rows = [(" ".join(rng.choice(words[:rng.randint(3, len(words))]) for _ in range(rng.randint(0, 60))),
             rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", "é", None])) for _ in range(300)]
    rows += [(None, "en", "only-null"), ("", "xx", "a"), ("rare", "xx", "b"), (" \x00\x7f12", None, "c"), ("solo solo", "yy", "one")]
    rows += [("same same again", "en", "s2")] * 4 + [("y" * 100_000 + " der " * 9, "en", "s1")] * 3
    return rows


def table(spark, rows):
    return spark.createDataFrame([(k % 7 or None, *r, "clash") for k, r in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, term string")


@pytest.mark.parametrize("slice_terms, held, at_once", [(divergence.SLICE, divergence.HELD, divergence.AT_ONCE), (5, 50, 40)])
def test_audit_equals_brute_force(spark, monkeypatch, slice_terms, held, at_once):
    monkeypatch.setattr(divergence, "SLICE", slice_terms)
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "AT_ONCE", at_once)
    rows = fixture()
    got = [tuple(r) for r in divergence.divergence_audit(table(spark, rows), top=7).collect()]
    want = brute(rows, top=7)
    assert len(got) == len(want) and set(got) == want


def test_sql_equals_brute_force(spark):
    rows = fixture()
    documents = table(spark, rows).toPandas()  # noqa: F841  read by DuckDB
    found = duckdb.sql(queries.ORACLE["op13_pair_task_divergence"]).fetchall()
    assert len(found) == len(set(found)) and {tuple(r[:4]) + (int(r[4]), r[5]) for r in found} == brute(rows)


def test_empty(spark):
    assert divergence.divergence_audit(table(spark, [("a", "b", "c")]).limit(0)).count() == 0


def test_merge_of_sparse_arrays():
    rng = random.Random(2)
    for _ in range(200):
        size = rng.randint(1, 30)
        p0, q0 = rng.randint(1, 9), rng.randint(1, 9)
        a = {i: rng.randint(1, 10 ** 9) for i in range(size) if rng.random() < rng.choice([0, .3, 1])}
        b = {i: rng.randint(1, 10 ** 9) for i in range(size) if rng.random() < rng.choice([0, .3, 1])}
        p, q = [a.get(i, p0) for i in range(size)], [b.get(i, q0) for i in range(size)]
        want = (sum((x - y) ** 2 // y for x, y in zip(p, q)), sum((x - y) ** 2 // x for x, y in zip(p, q)))
        arrays = lambda d: (np.array(list(d), np.int32), np.array(list(d.values()), np.int64))
        assert divergence.merge_prices(*arrays(a), p0, *arrays(b), q0, size) == want


def test_shares_beyond_64_bits(spark):
    from pyspark.sql import functions as F
    n, total, v = 9 * 10 ** 17, 10 ** 18, 10 ** 9
    c = lambda x: F.lit(x).cast("long")
    got = spark.range(1).select(divergence.share(c(n), c(total), c(v)).alias("p")).first().p
    assert got == 1 + SCALE * (n + 1) // (total + v)
