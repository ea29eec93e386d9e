"""Adaptive quality rules and best-fit packing."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from deskpass.llm import packing, quality


def brute_counts(text):
    words = [w for w in __import__("re").split(r"[ \t\n\r\x0b\x0c]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
    grams = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    n = Counter(grams)
    inside = {k for i, g in enumerate(grams) if n[g] > 1 for k in range(i, i + 8)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(inside), len(lines))


def test_counts_equal_brute_force():
    rng = random.Random(4)
    texts = [None, "", "\n \n", "a\x1cb \x85 c", "x" * 50_000, "a b\n" * 5, "é ü  日本 語\n語", "w " * 500]
    texts += [" ".join(rng.choice("abc") + rng.choice("\n ") * (rng.random() < .3) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    for t in texts:
        assert quality.text_counts(t) == brute_counts(t)


def test_quality_cases(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    clean = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, clean(rng.randint(25, 90)), "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, "k") for i in range(400)]
    rows += [(1000 + i, " ".join(w + "$$$" for w in clean(40).split()), "en", "s1", "k") for i in range(20)]
    # a source whose texts all hold symbols gets its own threshold
    rows += [(2000 + i, " ".join(w + "<>" * rng.randint(0, 2) for w in clean(60).split()), "code", "s1", "k") for i in range(150)]
    rows += [(3000, None, "en", "s0", "k"), (3001, "", None, None, "k"), (3002, "few words", "en", "s0", "k"),
             (3003, "same words come again and again so " * 20, "en", "s0", "k"), (3000, None, "en", "s0", "k"),
             (None, clean(40), "xx", "only", "k"), (3004, "$" * 400_000, "en", "s0", "k")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string")
    got = quality.quality_verdicts(d).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["kept"] for i in range(400))
    assert not any(by[1000 + i]["kept"] or by[1000 + i]["base_failed"] for i in range(20))
    assert sum(by[2000 + i]["kept"] for i in range(150)) >= 148
    assert by[3003]["base_failed"] and by[3000]["base_failed"] and by[3002]["n_words"] == 2
    assert by[None]["kept"]
    kept = quality.quality_filter(d)
    assert kept.columns == d.columns and kept.where("doc_id = 1003").count() == 0 and kept.where("doc_id = 7").count() == 1
    assert quality.quality_verdicts(d.limit(0)).count() == 0


def test_sketch_quantiles_are_close(spark):
    rows = [(i, " ".join([chr(97 + k) * (1 + (i * (7 + k % 2) + k) % 9) for k in range(26)]), "en", "s", 0) for i in range(500)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n int")
    counts = quality.count_columns(d, [quality.col("lang").alias("g_lang"), quality.col("source").alias("g_source")])
    counts = counts.withColumn("base_failed", quality.base_failed())
    q = quality._quartiles(quality.sketch(counts), ["g_lang", "g_source"], quality.GAMMA).where("feature = 'chars_per_word'").first()
    means = sorted(sum(map(len, t.split())) / 26 for _, t, *_ in rows)
    assert q["q25"] == pytest.approx(means[124], rel=.02) and q["q75"] == pytest.approx(means[374], rel=.02)


def optimum(items, capacity):
    items = sorted(items, reverse=True)
    best = [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins)}.values():
            if bins[k] + items[i] <= capacity:
                bins[k] += items[i]
                place(i + 1, bins)
                bins[k] -= items[i]
        place(i + 1, bins + [items[i]])

    place(0, [])
    return best[0]


def test_reduction_keeps_an_optimum():
    rng = random.Random(6)
    for _ in range(300):
        capacity = rng.choice([10, 20, 30])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 8))]
        counts = dict(Counter(items))
        fixed, left = packing.reduce_dominated(counts, capacity)
        rest = [w for w, n in left.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + (optimum(rest, capacity) if rest else 0) == optimum(items, capacity)
        used = Counter()
        for content, n in fixed + packing.best_fit(left, capacity):
            assert sum(content) <= capacity
            used.update({w: content.count(w) * n for w in set(content)})
        assert used == counts


def test_large_histogram_is_packed_close_to_the_bound():
    counts = {w: 300_000 // w for w in range(3, 1025)}
    bins = sum(n for c, n in sum(packing.reduce_dominated(counts, 1024)[:1], []))
    fixed, left = packing.reduce_dominated(counts, 1024)
    bins += sum(n for _, n in packing.best_fit(left, 1024))
    assert bins <= 1.001 * sum(w * n for w, n in counts.items()) / 1024


def test_chunked_ids_are_the_tokenizers(spark):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(packing.default_vocabulary())
    t.encode_special_tokens = True
    texts = ["  a  b\n\n\tc  x  ", "it's 'll ' s 12ab $$ x\x1cy \x1c z\x1c\x1c", "<|endoftext|> hi", " ", "\n", "日本語 テスト。",
             "a" * 3000, "\x85  x", "can't  \n don't\r\n\r\nx", "a  b　c   d", "\U0001f600 \U0001f600\U0001f600", "١٢ ½ x²"]
    e = packing.encoder(packing.default_vocabulary())
    for x in texts:
        assert np.frombuffer(e.packed(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_added_tokens_inside_texts_are_the_tokenizers(spark):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(packing.default_vocabulary())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x\n<|endoftext|><|endoftext|>  y z", "<|endoftext| > no", "one two " * 900 + "<|endoftext|>end"]
    assert t.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    want = Counter()
    for i, x in enumerate(texts):
        ids = t.encode(x, add_special_tokens=False).ids + [packing.END_ID]
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for a, b in zip(cuts, cuts[1:]):
            want[i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in packing.pieces(d).collect())
    assert got == want


def test_packing_round_trip(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["alpha", "be", "gamma", "dé", "x1"]) for _ in range(rng.choice([1, 5, 300, 900, 2500]))), i) for i in range(60)]
    rows += [(100, None, 0), (101, "", 0), (102, "same", 0), (102, "same", 0), (None, "same", 0), (103, "long text " * 20_000, 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, part int")
    got = packing.pack_documents(d).collect()
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(packing.default_vocabulary())
    want = Counter()
    for i, text, _ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    at = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 1024 and len(at) <= 1.02 * sum(at.values()) / 1024 + 1
    assert packing.pack_documents(d.limit(0)).count() == 0
