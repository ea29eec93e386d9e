"""Sharding, surrogates, wrappers, licences, decontamination, language ID."""

import hashlib
import html
import itertools
import math
import re

import numpy as np
from pyspark.sql import functions as F

from deskpass.llm import decontam, langid, licenses, sharding, surrogates, wrappers


def brute_shards(rows, limit):
    bits = {k: bin(int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16))[2:].zfill(60) for k, _ in rows}
    out = {}
    todo = [("", rows)]
    while todo:
        prefix, own = todo.pop()
        if sum(n for _, n in own) <= limit or len(own) == 1:
            out |= {k: prefix for k, _ in own}
        else:
            for b in "01":
                part = [r for r in own if bits[r[0]].startswith(prefix + b)]
                if part:
                    todo.append((prefix + b, part))
    return out


def test_shards_equal_splitting_by_hand(spark):
    rows = [(i, "x" * (i * 37 % 200)) for i in range(700)] + [(9000, "y" * 5000)]
    d = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, shard string")
    got = sharding.assign_shards(d, limit=1000).collect()
    want = brute_shards([(i, len(t)) for i, t in rows], 1000)
    assert {r["key"]: r["shard"] for r in got} == want
    assert all((r["shard_bytes"] <= 1000) != r["oversize"] for r in got)
    assert [r["key"] for r in got if r["oversize"]] == [9000]
    assert sharding.assign_shards(d.limit(0)).count() == 0


def test_one_key_with_all_rows_still_splits(spark, tmp_path):
    rows = [(None if i % 2 else 1, "x" * 100 if i % 7 else None) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sharding.assign_shards(d, limit=500).collect()
    assert len(got) == 300 and max(r["shard_bytes"] for r in got) <= 500
    size = {}
    for r in got:
        size[r["shard"]] = size.get(r["shard"], 0) + r["n_bytes"]
    assert max(size.values()) <= 500
    u = spark.createDataFrame([(i, "z" * 50) for i in range(100)], "doc_id long, text string")
    given = sharding.write_shards(u, str(tmp_path / "out"), limit=400)
    back = {r["doc_id"]: r["shard"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert back == {r["key"]: "b" + r["shard"] for r in given.collect()} and len(back) == 100


PII = [
    (1, "Write to anna.b7@mail3.example.com or ANNA.B7@MAIL3.EXAMPLE.COM today."),
    (2, "Call +1 (017) 555-7713 2390409500 or +1 017 555 7713, card 4539578763621486, 4539 5787 6362 1486."),
    (3, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" from 97.51.17.173 and 10.0.0.7, 192.168.3.4'),
    (4, "Mr. John Smith met Mrs Jane Smith and Dr Smith. Frau Müller. Г-н Иван Петров. 王小明先生, 김철수 씨"),
    (5, "No personal data: 12 apples, 3.5 kg, version 1.2.3, 2024-01-02."),
    (6, None), (7, ""), (6, None), (None, "x@y.example.org"), (8, "DE44500105175407324931 and 123-45-6789"),
    (9, "a@b.example.org " * 2000),
]


def test_surrogates(spark):
    more = [(100 + i, f"{c}@z.example.net and {c}{c}@z.example.net") for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")]
    d = spark.createDataFrame([(i, t, "h", 5) for i, t in PII + more], "doc_id long, text string, news string, norm int")
    out = surrogates.replace_pii(d, count_col="n")
    assert out.columns == [*d.columns, "n"]
    rows = out.collect()
    assert len(rows) == len(PII) + len(more)
    got = {r["doc_id"]: r["text"] for r in rows}
    a, b = re.findall(r"\S+@\S+", got[1])
    assert a.upper() == b and a != "anna.b7@mail3.example.com" and re.fullmatch(r"[a-z]{4}\.[a-z]\d@[a-z]{4}\d\.[a-z]{7}\.com", a)
    m = re.fullmatch(r"Call \+1 \((\d{3})\) (\d{3})-(\d{4}) 2390409500 or \+1 (\d{3}) (\d{3}) (\d{4}), card (\d{16}), (\d{4}) (\d{4}) (\d{4}) (\d{4})\.", got[2])
    assert m and m.groups()[:3] == m.groups()[3:6] and "".join(m.groups()[7:]) == m[7]
    luhn = lambda s: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0
    assert luhn("4539578763621486") == luhn(m[7]) and m[7][0] == "4" and m[7] != "4539578763621486"
    assert re.search(r'^token = "[0-9a-f]{40}" from ', got[3]) and "04dbebab" not in got[3] and "97.51.17.173" not in got[3]
    assert len(re.findall(r"\b10\.\d+\.\d+\.\d+", got[3])) == 2
    m = re.match(r"Mr\. (\w+) (\w+) met Mrs (\w+) (\w+) and Dr (\w+)\. Frau (\w+)\. Г-н (\w+) (\w+)\. (\w+)先生, (\w+) 씨", got[4])
    assert m and m[2] == m[4] == m[5] != m[6] and "Smith" not in got[4]
    assert m[1] in surrogates.GIVEN["latin_m"] and m[3] in surrogates.GIVEN["latin_f"] and m[7] in surrogates.GIVEN["cyrillic_m"]
    assert re.fullmatch(r"[а-яА-Я]+", m[8]) and re.fullmatch(r"[一-鿿]+", m[9]) and re.fullmatch(r"[가-힣]+", m[10])
    assert got[5] == PII[4][1] and got[6] is None and got[7] == ""
    assert re.fullmatch(r"DE\d{20} and \d{3}-\d{2}-\d{4}", got[8]) and got[8] != PII[9][1]
    assert len(set(got[9].split())) == 1 and got[9].count("@") == 2000
    # all one-letter mailboxes are real, so their surrogates must grow, and all differ
    first = [got[100 + i].split("@")[0] for i in range(26)]
    assert len(set(first)) == 26 and all(len(x) > 1 for x in first)
    assert surrogates.replace_pii(d, count_col="n").exceptAll(out).count() == 0
    assert surrogates.replace_pii(d.limit(0)).count() == 0
    assert "ArrowEvalPython" not in out._jdf.queryExecution().toString() and "MapInArrow" not in out._jdf.queryExecution().toString()


def page(title, paras, extra=""):
    body = "".join(f"<p>{p}</p>" for p in paras)
    return (f"<!DOCTYPE html><html><head><title>{title}</title><script>var t='</p>';</script></head><body><header>Site</header>"
            f"<nav><ul><li><a href='/a'>A</a></li><li>B</li></ul></nav>{extra}<article><h1>{title}</h1>{body}</article>"
            f"<div class='comments'><p>reader</p></div><footer>&copy; x</footer></body></html>")


def test_pages(spark):
    rows = [(i, f"http://h{i % 3}.example.com/{i}", page(f"T {i}", [f"p {i} {k} &amp; q" for k in range(i % 5)],
             "<div class='ad'>buy</div>" if i % 2 else "<aside>x<p>y</aside>"), "w") for i in range(60)]
    rows += [(100, None, "bare &lt;text&gt;  here", "w"), (101, "http://h0.example.com/x", None, "w"), (102, "odd", "", "w"),
             (103, "http://h0.example.com/y", "<article><p>one<p><b>two<br>three</article", "w"),
             (104, "http://solo.example.com/", "<div><div id=content><h2>H</h2><p>a  b<!-- no --> c</div><form>f</form></div>", "w"),
             (0, "http://h0.example.com/0", rows[0][2], "w"), (105, "http://h1.example.com/z", "<p>" * 3000 + "deep", "w")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, wrapper string")
    got = wrappers.extract_articles(d.repartition(7)).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r["text"] for r in got}
    for i in range(60):
        assert by[i] == "\n\n".join([f"T {i}", *[f"p {i} {k} & q" for k in range(i % 5)]])
    assert by[100] == "bare <text> here" and by[101] == "" and by[102] == "" and by[103] == "one\n\ntwo three"
    assert by[104] == "H\n\na b c" and by[105] == "deep"
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert wrappers.extract_articles(d.limit(0)).count() == 0
    # many expressions per host meet in rounds
    w = wrappers.infer_wrappers(d.repartition(30), fan=2).collect()
    assert len(w) == len({r["host"] for r in w}) and sum(r["pages"] for r in w) == len(rows) - 1


def test_written_forms_of_numbers_are_found(spark):
    forms = ["PL61109010140000071219812874", "SE45 5000 0000 0583 9825 7466", "GB29 NWBK 6016 1331 9268 19", "DE89 3704 0044 0532 0130 00",
             "NO93 8601 1117 947", "3782 822463 10005", "3056-930902-5904", "4111 1111 1111 1111", "030 12345678", "01 23 45 67 89",
             "555 123 4567", "020 7946 0958", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "fe80::1ff:fe23:4567"]
    rows = [(i, f"Write to {x}, please") for i, x in enumerate(forms)]
    plain = ["At 12:30:45 and std::vector<a> of 12 34 56", "on 01-02-2003 or 2003-02-01, 1 000 000 people", "a::b, 10:20"]
    rows += [(100 + i, t) for i, t in enumerate(plain)]
    got = {r["doc_id"]: r for r in surrogates.replace_pii(spark.createDataFrame(rows, "doc_id int, text string"), count_col="n").collect()}
    for i, x in enumerate(forms):
        t = got[i]["text"]
        assert got[i]["n"] == 1 and t.startswith("Write to ") and t.endswith(", please") and x not in t
        if ":" not in x:  # the same separators, nothing of the number left in place
            new = t[len("Write to "):-len(", please")]
            assert [c for c in new if not c.isalnum()] == [c for c in x if not c.isalnum()]
            assert sum(a == b for a, b in zip(new[4:], x[4:])) < len(x) - 4
    assert [got[100 + i]["text"] for i in range(len(plain))] == plain


def test_items_without_templates_are_found_by_their_words(spark):
    items = [(1, "What Is The Capital City Of France And Of Spain"), (2, "12 + 7 km = 19 Alice 4 Bob 5"), (3, "quantum cat paradox"),
             (4, "水的沸点是多少摄氏度"), (5, "東京タワーの高さは何メートルですか"), (6, "ALL OF THIS STANDS IN CAPITALS HERE"),
             (7, "what kind of bird can fly backwards for a long time")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    rows = [(i, f"words before it stand here {t} and some more after it") for i, t in items[:3] + items[5:]]
    rows += [(4, "前文" + items[3][1] + "后文"), (5, "まえ" + items[4][1] + "あと"), (None, "x " + items[0][1])]
    rows += [(50, "the cat of france is a quantum paradox, 12 + 9 km"), (51, "水是多少东西"), (52, None), (53, "")]
    got = decontam.contaminated(spark.createDataFrame(rows, "doc_id int, text string"), bench).collect()
    assert sorted(((r["doc_id"] or 0), r["item_id"]) for r in got) == [(0, 1), *[(i, i) for i in range(1, 8)]]
    assert all(r["n_windows"] > 0 and r["coverage"] == 1 for r in got)


def test_wrapper_without_article_keeps_what_varies():
    make = lambda t: f"<body><div class=top>Shop</div><div><h2>{t}</h2><p>{t} text</p></div><p>Imprint</p></body>"
    a, b = (wrappers.fold(wrappers.page_terms(list(wrappers.texts(make(t)))))[0] for t in ("One", "Two"))
    w = wrappers.dump(wrappers.align(a, b))
    assert wrappers.extract(make("One"), w, 2) == "One\n\nOne text"
    assert html.unescape("&amp") == "&"


def test_what_one_page_has_is_not_boilerplate():
    bodies = ["<h2>One</h2><p>First</p><blockquote><p>Once said</p></blockquote><p>More</p>", "<h2>Two</h2><p>Second</p><pre>x = 1</pre>",
              "<h2>Three</h2><p>Third</p><table><tr><td>cell</td></tr></table>", "<h2>Four</h2><p>Fourth</p><h3>Part</h3><p>Last</p>"]
    pages = [f"<body><div class=top>Shop</div><div>{b}</div><p>Imprint</p></body>" for b in bodies]
    terms = None
    for p in pages:
        own = wrappers.fold(wrappers.page_terms(list(wrappers.texts(p))))[0]
        terms = wrappers.align(terms, own) if terms else own
    got = [wrappers.extract(p, wrappers.dump(terms), len(pages)) for p in pages]
    assert got == ["One\n\nFirst\n\nOnce said\n\nMore", "Two\n\nSecond\n\nx = 1", "Three\n\nThird\n\ncell", "Four\n\nFourth\n\nPart\n\nLast"]


def test_cues_are_whole_classes():
    page = ("<body><div class='share-price'><p>Up 3</p></div><div class='search-results-explained'><p>How</p></div>"
            "<div class='cookie-banner'><p>Accept</p></div><div id=site-nav><p>Home</p></div></body>")
    assert wrappers.extract(page, None) == "Up 3\n\nHow"
    assert wrappers.extract("<body><nav>Home</nav><div class=comments><p>All there is</p></div></body>", None) == "All there is"


def test_patience_alignment():
    a, b = "x the mit license is the best license".split(), "the mit license the license".split()
    pairs = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs) and len(pairs) == 5
    assert licenses.align([], b) == [] and licenses.align(["q"], b) == []


def test_sibling_licenses_are_told_apart():
    known = licenses.templates(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        found = licenses.scan(f"Some words. {text} And more of them.", known)
        assert [f[0] for f in found] == [name], (name, found)
    clauses = licenses.TEMPLATES["BSD-conditions"]
    assert licenses.TEMPLATES["BSD-2-Clause"].startswith(clauses) and "Neither the name" in licenses.TEMPLATES["BSD-3-Clause"]
    for kind, name in (("Lesser", "LGPL"), ("Affero", "AGPL")):
        notice = f"This work is licensed under the GNU {kind} General Public License, version 3."
        assert [f[0] for f in licenses.scan(notice, known)] == [f"{name}-3.0-notice"]
    old = licenses.TEMPLATES["BSD-2-Clause"].replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", "REGENTS")
    assert [f[0] for f in licenses.scan(old, known)] == ["BSD-2-Clause"]


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"].replace("obtaining", "getting")
    rows = [(1, "Ver. intro text\nReleased under the MIT License.\nmore\nReleased under the MIT license"), (2, "x " * 300 + mit + " tail words"),
            (3, "Licensed under CC BY-NC 4.0."), (4, "Licensed under the Foo License."), (5, None), (6, ""),
            (7, "license " * 5000), (8, "This work is licensed under the GNU General Public License, version 3."),
            (None, "Licensed under the Apache License, Version 2.0."), (3, "Licensed under CC BY-NC 4.0.")]
    d = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, license string")
    got = sorted(((r["doc_id"] or 0, r["license"], r["coverage"], r["start_char"], r["end_char"]) for r in licenses.scan_licenses(d).collect()))
    assert [g[:2] for g in got] == [(0, "Apache-2.0-notice"), (1, "MIT-notice"), (1, "MIT-notice"), (2, "MIT"),
                                    (3, "CC-BY-NC-4.0-notice"), (3, "CC-BY-NC-4.0-notice"), (8, "GPL-3.0-notice")]
    assert got[1][3:] == (16, 46) and 0.95 < got[3][2] < 1
    assert rows[1][1][got[3][3]:got[3][4]].startswith("Permission is hereby") and rows[1][1][:got[3][4]].endswith("the Software")
    assert licenses.scan_licenses(d.limit(0)).count() == 0


def test_reparameterised_questions(spark):
    item = "Tom walks 12 km from Paris to the old mill and then rides 30 miles with Anna before he rests for 2 hours just outside Paris once more that very evening"
    other = item.replace("Tom", "Bob").replace("12", "99").replace("Paris", "Rome").replace("Anna", "Eve").replace("km", "miles")
    mixed = other.replace("outside Rome once", "outside Oslo once")
    broken = "Tom walks 12 km from Paris. Nothing else is like the question at all, in none of its other words or places."
    rows = [(1, "Intro words here. " + item), (2, "so it goes: " + other + ". The end"), (3, mixed), (4, broken), (5, None), (6, ""),
            (7, "filler words " * 20_000 + item), (None, item), (1, "Intro words here. " + item)]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, at int, item_id string")
    bench = spark.createDataFrame([(10, item), (11, "too short"), (12, None), (13, "1 2 3 4 5 6 7")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in decontam.contaminated(d, bench).collect()}
    assert set(got) == {(1, 10), (2, 10), (3, 10), (7, 10), (None, 10)}
    assert got[2, 10] == 1.0 and got[3, 10] < 1.0
    kept = decontam.decontaminate(d, bench)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 6]
    assert decontam.contaminated(d.limit(0), bench).count() == 0 and decontam.decontaminate(d, bench.limit(0)).count() == len(rows)


def segmentations(word, pieces):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in pieces:
            for rest in segmentations(word[k:], pieces):
                yield [word[:k], *rest]


def test_forward_sums_all_segmentations():
    pieces = [b"a", b"b", b"ab", b"ba", b"aab", b" a", b" ", b"bab"]
    lat = langid.Lattice(pieces)
    p = np.random.default_rng(3).random((len(pieces), 2))
    words = [b" ab", b"aabab", b"b", b" aababbaab", b"xyz"]
    got = lat.log_likelihood(words, p)
    expected = np.zeros(len(pieces))
    for w, row in zip(words, got):
        ways = list(segmentations(w, set(pieces)))
        for k in range(2):
            total = sum(math.prod(p[pieces.index(x), k] for x in s) for s in ways)
            assert math.isclose(row[k], math.log(max(total, 1e-300)))
            if k == 0 and total:
                for s in ways:
                    for x in s:
                        expected[pieces.index(x)] += 3 * math.prod(p[pieces.index(y), 0] for y in s) / total
    assert np.allclose(lat.expected(words, np.full(len(words), 3.0), p[:, 0]), expected)
    assert sum(1 for _ in itertools.islice(segmentations(b"aab", set(pieces)), 9)) == 3


def test_long_words_sum_all_segmentations_too(monkeypatch):
    """Words beyond the size of a batch, with pieces as long as they come, against a plain forward pass."""
    rng = np.random.default_rng(8)
    pieces = [b" ", *{bytes(rng.choice(list(b"abc"), k)) for k in (1, 1, 1, 2, 2, 3, 5, 9, 14, 40) for _ in range(6)}, "é".encode(), b"\xc3", b"\xa9"]
    lat = langid.Lattice(pieces)
    p = rng.random((len(pieces), 2)) * .1
    words = [b" " + bytes(rng.choice(list(b"abc"), n)) for n in (33, 60, 60, 250, 3000)] + [b" " + "é".encode() * 60]
    words += [b" x" + words[0], pieces[-5] * 3]

    def plain(w, k):
        logs = [0.0] + [-math.inf] * len(w)
        for end in range(1, len(w) + 1):
            ways = [logs[end - len(x)] + math.log(p[i, k]) for i, x in enumerate(pieces) if w[:end].endswith(x)]
            logs[end] = float(np.logaddexp.reduce(ways)) if ways else -math.inf
        return logs[-1]

    for size in (langid.POSITIONS, 50):
        monkeypatch.setattr(langid, "POSITIONS", size)
        got = lat.log_likelihood(words, p)
        for w, row in zip(words, got):
            for k in range(2):
                true = plain(w, k)
                assert math.isclose(row[k], true, rel_tol=1e-9) if math.isfinite(true) else row[k] < -600
    many = lat.expected(words[:3], np.ones(3), p[:, 0])
    monkeypatch.setattr(langid, "AT_ONCE", 100)
    assert np.allclose(many, lat.expected(words[:3], np.ones(3), p[:, 0]))


def test_letters_are_of_category_l():
    assert langid.words_of("½ ② Ⅷ 12 _ !?") == []
    assert langid.words_of("a½b ÉtÉ x2 日本") == [b" a", b" b", " été".encode(), b" x", " 日本".encode()]


def test_letterless_learning_batch(spark):
    rows = [(1, "123 !!", "de"), (2, "der Hund und die Katze", "de"), (4, "½ ②", None), (6, "", "fr")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8, "doc_id")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(d).collect()}
    assert got == {1: ("und", 0.0), 2: ("de", 1.0), 4: ("und", 0.0), 6: ("und", 0.0)}


def test_language_cases(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(90001, None, "en"), (90002, "", None), (90003, "123 !!", "de"), (None, "the and of that", "en"),
                                 (90005, "langeswort" * 30_000, None), (90006, "The and of in", None)], "doc_id long, text string, lang string")
    both = d.unionByName(odd).withColumn("score", F.lit("clash")).withColumn("p", F.lit(1))
    got = langid.identify(both).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 1006 and {r["lang_pred"] for r in got} == {"en", "de", "fr", "es", "und"}
    assert [by[i]["lang_pred"] for i in (90001, 90002, 90003)] == ["und"] * 3 and by[90003]["score"] == 0
    assert by[None]["lang_pred"] == "en" and not by[None]["held_out"]
    import zlib
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    truth = {r["doc_id"]: r["lang"] for r in d.collect()}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    kept = langid.language_filter(both)
    assert kept.columns == both.columns and kept.where("doc_id in (90001, 90002, 90003)").count() == 0 and kept.count() >= 1000
    assert langid.identify(odd.where("lang is null")).select("lang_pred").distinct().collect()[0][0] == "und"
    assert langid.identify(both.limit(0)).count() == 0
