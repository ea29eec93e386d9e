"""Substring dedup, SimHash near-dedup and connected components against brute force."""

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from deskpass.llm import simhash, substring
from deskpass.llm.components import components

DOCS = "doc_id long, text string, fp long, text_hash string, `a.b` int, nth int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 7, "x", 1, 2) for i, t in rows], DOCS)


def prose(rng, n):
    out = []
    while len(out) < n:
        k = rng.randint(4, 12)
        s = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(k)]
        out += [s[0].capitalize(), *s[1:-1], s[-1] + "."]
    return out[:n]


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(500, 500 + k) for k in range(60)]
    edges += [(k, k + 1) for k in range(700, 740)] + [(None, 3), (4, 4)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    s = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)]
    h = [xxhash.xxh64(x, seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_is_the_stated_one(spark):
    rng = random.Random(1)
    for text in [None, "", " \n\t", "One", "ONE two", "É É\x0bé\x1cx", *[" ".join(prose(rng, n)) for n in (3, 4, 5, 200)]]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)
    long = "word other " * 100_000
    assert simhash.fingerprint(long) == simhash.fingerprint(long.upper())
    # Spark's own hash is the same function
    got = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()[0]
    assert got % (1 << 64) == xxhash.xxh64(b"a b c", seed=42).intdigest()


def test_every_point_has_an_anchor_within_the_radius():
    x = np.random.default_rng(5).integers(0, 1 << 61, 20_000, dtype=np.int64)
    a = simhash._anchor(x)
    gap = np.bitwise_count((a ^ x).view(np.uint64))
    assert gap.max() <= 7 and len(np.unique(simhash._anchor(a) ^ a)) == 1


def test_links_lose_nothing(spark):
    rng = random.Random(7)
    fps = set()
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 3, 40])):
            y = base
            for b in rng.sample(range(64), rng.randint(0, 4)):
                y ^= 1 << b
            fps.add(y)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    df = spark.createDataFrame(signed, "fp long")
    for max_bits, cell in ((2, 16), (2, 2), (3, 4), (0, 16)):
        want = {}
        nodes = sorted(x for x, in signed)
        for i, a in enumerate(nodes):
            for b in nodes[i + 1:]:
                if bin((a ^ b) & (1 << 64) - 1).count("1") <= max_bits:
                    want.setdefault(a, set()).add(b)
                    want.setdefault(b, set()).add(a)
        root, seen = {}, set()
        for a in nodes:
            if a in want and a not in seen:
                group, todo = set(), [a]
                while todo:
                    n = todo.pop()
                    if n not in group:
                        group.add(n)
                        todo += want[n]
                seen |= group
                root |= {n: min(group) for n in group}
        got = {r["node"]: r["root"] for r in components(simhash.links(df, max_bits, cell)).collect()}
        assert got == root


def test_simhash_cases(spark):
    rng = random.Random(2)
    base = prose(rng, 400)
    near = base[:200] + ["changed"] + base[201:]
    rows = [(5, " ".join(base)), (3, " ".join(base)), (9, " ".join(prose(rng, 300))), (3, " ".join(base)),
            (None, " ".join(base)), (7, None), (8, ""), (6, " \n "), (None, "alone here")]
    rows.append((4, " ".join(near)))
    d = docs(spark, rows)
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.simhash_components(d).collect()}
    fp = lambda t: f"{brute_fingerprint(t):016x}"
    assert got[5, fp(rows[0][1])] == got[3, fp(rows[0][1])] == got[None, fp(rows[0][1])] == 3
    assert got[7, "0" * 16] == got[8, "0" * 16] == got[6, "0" * 16] == 6
    assert got[None, fp("alone here")] is None
    assert len(simhash.simhash_components(d).collect()) == len(rows)
    kept = simhash.simhash_dedup(d)
    assert kept.columns == d.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.select("doc_id").collect())
    close = bin(brute_fingerprint(rows[0][1]) ^ brute_fingerprint(rows[-1][1])).count("1") <= 2
    assert ids == sorted([(False, 3), (False, 6), (False, 9), (True, None)] + ([] if close else [(False, 4)]))
    assert simhash.simhash_components(d.limit(0)).count() == 0 and simhash.simhash_dedup(d.limit(0)).count() == 0


def brute_shared(rows, run):
    seen = {}
    for i, t in rows:
        w = (t or "").lower().split()
        for k in range(len(w) - run + 1):
            seen.setdefault(tuple(w[k:k + run]), set()).add(i)
    return set().union(*[s for s in seen.values() if len(s) > 1], set())


def test_passages_anywhere_are_found(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(prose(rng, rng.randint(40, 200)))) for i in range(40)]
    passage = prose(rng, 60)
    edited = passage[:30] + ["other"] + passage[31:]
    for i, p, cut in ((1, passage, " "), (2, passage, "\n"), (3, edited, " "), (4, passage, " ")):
        w = rows[i][1].split()
        k = rng.randint(1, len(w) - 2)
        rows[i] = (i, " ".join(w[:k]) + cut + " ".join(p[:25]) + cut + " ".join(p[25:]) + " " + " ".join(w[k:]))
    rows += [(50, "lower case words without any stop " * 20), (51, "x " + "lower case words without any stop " * 20)]
    rows += [(60, "one " * 90), (61, "start one two " + "one " * 90)]
    twice = " ".join(prose(rng, 60))
    rows += [(70, twice + "\n" + twice), (None, twice), (80, None), (81, ""), (82, "short text")]
    d = docs(spark, rows)
    got = substring.repeated_passages(d).collect()
    flagged = {r["doc_id"] for r in got}
    known = [(i, t) for i, t in rows if i is not None]
    assert brute_shared(known, 51) <= flagged and 3 in flagged
    assert not {i for i in flagged if i not in brute_shared(known, 20)}
    by = {r["doc_id"]: r for r in got if r["doc_id"] in (1, 2, 3, 4)}
    assert not by[1]["removed"] and by[2]["removed"] and by[4]["first_doc_id"] == 1
    assert substring.repeated_passages(d.limit(0)).count() == 0
    left = {r["doc_id"]: r["text"] for r in substring.without_repeats(d).collect()}
    assert left[1] == dict(rows)[1] and len(left[2].split()) < len(dict(rows)[2].split()) and left[80] is None


def test_many_variants_of_a_passage_are_one_component(spark):
    rng = random.Random(12)
    base = prose(rng, 36)
    rows = []
    for i in range(80):
        p = list(base)
        if i % 2:
            p[rng.randint(1, 35)] = f"v{i}"
        rows.append((i, " ".join(p)))
    got = substring.repeated_passages(docs(spark, rows)).collect()
    assert {r["doc_id"] for r in got} >= {i for i in range(0, 80, 2)}
    assert len({r["first_doc_id"] for r in got}) == 1


def test_edit_distance_equals_the_table():
    rng = random.Random(13)
    for _ in range(300):
        a = [rng.choice(b"abc") for _ in range(rng.randint(0, 12))]
        b = [rng.choice(b"abc") for _ in range(rng.randint(0, 12))]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            left, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
        for cap in range(13):
            assert substring.distance(a, b, cap) == min(row[-1], cap + 1)
    assert substring._limit(5, 4, 0.8) == 1 and substring._limit(4, 4, 0.8) == 0


def test_lines_of_a_key_are_linked_as_by_all_pairs(spark):
    rng = random.Random(21)
    texts = []
    for _ in range(6):
        base = [rng.choice("abcdefgh") for _ in range(20)]
        for _ in range(9):
            t = list(base)
            for _ in range(rng.randint(0, 7)):
                t[rng.randrange(20)] = rng.choice("abcdefgh")
            texts.append(t)
    classes = [substring.class_of(substring._words(" ".join(t).encode())[0], True) for t in texts]
    rows = [(i, 0, 20, classes[i], k) for i in range(len(texts)) for k in (1, 2 + i % 2)]
    lines = spark.createDataFrame(rows, "doc_id long, pos int, n int, cls long, key long")
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    root = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            if substring.distance(a, b, 4) <= 4 and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    got = {r["cls"]: r["root"] for r in substring.class_roots(lines, d, "doc_id", "text", 0.8).collect()}
    own = [got.get(c, c) for c in classes]
    assert all((own[i] == own[j]) == (root[i] == root[j]) for i in range(len(texts)) for j in range(i))
    assert 6 <= len(set(root)) < len(texts)


def test_edited_passages_inside_other_texts_are_found(spark):
    """One changed word in every 23: no window of 24 words is the same in both texts."""
    rng = random.Random(31)
    rows = []
    for i in range(12):
        passage = prose(rng, 92)
        edited = [f"changed{k}" if k % 23 == 11 else w for k, w in enumerate(passage)]
        for k, p in enumerate((passage, edited)):
            rows.append((2 * i + k, " ".join(prose(rng, 70) + p + prose(rng, 70))))
    rows.append((30, " ".join(prose(rng, 232))))
    got = substring.repeated_passages(docs(spark, rows)).collect()
    assert {r["doc_id"] for r in got} == set(range(24))
    assert all(r["first_doc_id"] == r["doc_id"] // 2 * 2 for r in got)


def test_edits_at_every_place_of_a_passage_are_found(spark):
    """Passages of 40 words inside different lines, two words of the copy exchanged side by side, at every place."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvw") for _ in range(rng.randint(3, 9)))
    text = lambda n: [word() if k % 9 else word().capitalize() for k in range(n)]
    rows = []
    for at in range(39):
        passage = text(40)
        passage[0] = passage[0].capitalize()
        other = list(passage)
        other[at:at + 2] = [word().capitalize() if x[0].isupper() else word() for x in other[at:at + 2]]
        rows += [(2 * at, " ".join(text(7) + passage + text(9))), (2 * at + 1, " ".join(text(11) + other + text(5)))]
    got = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r["doc_id"] for r in got}
    assert len(found) >= .9 * len(rows)
    assert all(r["first_doc_id"] // 2 == r["doc_id"] // 2 for r in got)


def test_rows_that_share_an_id_keep_their_words(spark):
    rng = random.Random(22)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvw") for _ in range(rng.randint(3, 9)))
    passage = ["Xanadu"] + [word() for _ in range(35)]
    near = list(passage)
    near[10] = "changed"
    rows = [(7, " ".join(["Aaa"] + [word() for _ in range(60)])), (7, " ".join(passage)), (8, " ".join(near))]
    got = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == {7, 8} and {r["doc_id"] for r in got if r["removed"]} == {8}


def test_windows_a_word_apart_are_no_copies(spark):
    """In title case a window begins at every word; what surrounds a shared passage is not part of it."""
    rng = random.Random(32)
    title = lambda n: [w.strip(".").capitalize() for w in prose(rng, n)]
    passage = title(40)
    d = docs(spark, [(1, " ".join(title(90) + passage + title(90))), (2, " ".join(title(60) + passage + title(60)))])
    got = {r["doc_id"]: (r["start_word"], r["end_word"]) for r in substring.repeated_passages(d).collect()}
    assert got.keys() == {1, 2}
    for i, at in ((1, 90), (2, 60)):
        assert at - 4 <= got[i][0] <= at + 4 and at + 36 <= got[i][1] <= at + 44


def test_keys_reach_what_the_edit_distance_accepts():
    rng = random.Random(33)
    for n in (24, 50, 100):
        met = 0
        for _ in range(200):
            a = [f"w{rng.getrandbits(40)}" for _ in range(n)]
            b = list(a)
            for k in rng.sample(range(n), substring._limit(n, n, substring.LEAST)):
                b[k] = f"x{rng.getrandbits(40)}"
            keys = []
            for words in (a, b):
                *_, key, line = substring.paragraphs_of(" ".join(words))
                keys.append(set(key[line].tolist()))
            met += bool(keys[0] & keys[1])
        assert met >= 190
    assert substring.paragraphs_of("one two " * 20)[4].any()  # lines that repeat themselves have keys too


def test_bits_tell_texts_apart_that_repeat_their_words():
    """Never more bits apart than words may be edited, also where the words are the same and only their numbers differ."""
    rng = random.Random(41)
    hashes = lambda words: substring._words(" ".join(words).encode())[0]
    apart = lambda x, y: int(np.bitwise_count(x & ~y).sum())
    for n in (24, 60):
        a = [rng.choice("abcdefghijklmnop") for _ in range(n)]
        b = list(a)
        for k in rng.sample(range(n), 4):
            b[k] = rng.choice("abcxyz")
        x, y = substring._bits([hashes(a), hashes(b)])
        assert max(apart(x, y), apart(y, x)) <= substring.distance([w.encode() for w in a], [w.encode() for w in b], n)
    x, y, z = substring._bits([hashes(["in"] * 18 + ["er"] * 6), hashes(["in"] * 6 + ["er"] * 18), hashes([])])
    assert min(apart(x, y), apart(y, x)) > substring._limit(24, 24, substring.LEAST) and not z.any()


def test_words_of_many_passages_are_read_a_few_documents_at_a_time(spark, monkeypatch):
    rng = random.Random(42)
    texts = [" ".join(w.capitalize() for w in prose(rng, 60)) for _ in range(300)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = []
    for i, t in enumerate(texts):
        h = substring._words(t.encode())[0]
        rows += [(substring.class_of(h[p:p + 24], False), i, p, 24) for p in range(0, 36, 3)]
    samples = spark.createDataFrame(rows, "cls long, doc_id long, pos int, n int")
    found = substring._texts(d, samples, "doc_id", "text", False)
    assert {r["cls"]: bytes(r["words"]) for r in found.collect()} == {
        c: b" ".join(texts[i].lower().encode().split()[p:p + n]) for c, i, p, n in rows}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan


def test_long_texts_give_their_keys_in_bounded_batches(spark):
    rng = random.Random(43)
    vocabulary = [w.capitalize() for w in prose(rng, 500)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(30_000)) for _ in range(3)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = substring.paragraphs(d)
    sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long")
    assert rows.count() == sum(len(substring.paragraphs_of(t)[0]) for t in texts) and sizes.count() > 1
