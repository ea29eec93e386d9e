"""Main text of web pages by wrappers inferred from the pages of each host.

A wrapper is a union-free regular expression over a host's pages: a sequence of
terms, each a container's start or end, a text (constant, or a slot if pages
differ there) or a group, and each term may be optional or repeated. Inference
starts from single pages, whose adjacent repeats are folded into repeated groups,
and aligns expressions two at a time: what matches is merged (different texts
become a slot), what does not becomes optional.

Alignment happens wherever pages are: every task folds the pages of a host that it
holds into one expression before anything is shuffled, and expressions then meet in
rounds of at most ``FAN`` per task and host, so a host with a third of all pages is
as much work per task as any other. HTML is never shuffled for inference. Each text
term is judged once per wrapper; pages are then matched against their host's
wrapper and the texts under kept terms returned.

Kept: texts inside ``article`` or ``main`` (where the host has such), else all texts but
those on which several pages agree (a text seen on one page only is that page's own); never
what lies in navigation, headers, footers, asides, forms, adverts, notices, comments, scripts
or styles. A class, id or role marks these as a whole ("share", "cookie-banner", not
"share-price"); a page with nothing else keeps what only such marks would have dropped.

Defined cases: null html gives the empty string; a null or odd URL belongs to the
host ""; a page alone on its host, or without anything that the wrapper keeps, is its own
wrapper; cut-off tags, unclosed elements
and bare text are read as far as they go; an empty table gives no rows.
"""

from __future__ import annotations

import html as htmllib
import json
import re
import zlib
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskpass.llm.common import bounded_batches, col, need, stage

FAN = 64          # expressions aligned by one task and host in a round
LONGEST_PERIOD = 8  # terms in a repeated group

# Element kinds of HTML.
LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "pre", "figcaption", "caption",
          "summary", "legend", "address", "option"}
CONTAINERS = {"html", "head", "body", "div", "section", "article", "main", "header", "footer", "nav", "aside", "form",
              "ul", "ol", "dl", "table", "thead", "tbody", "tfoot", "tr", "figure", "blockquote", "fieldset",
              "details", "dialog", "menu", "button", "select", "noscript", "template", "svg", "iframe", "object",
              "label", "center", "search", "hgroup"}
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
DROPPED = {"head", "nav", "footer", "aside", "form", "dialog", "menu", "button", "select", "noscript", "template",
           "svg", "iframe", "object", "fieldset", "search"}
# Words of a class, id or role that mark what is not the article.
DROPPED_CUES = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo",
                "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead",
                "cookie", "cookies", "consent", "notice", "banner", "popup", "modal", "newsletter", "subscribe",
                "comment", "comments", "disqus", "share", "sharing", "social", "related", "recommended", "widget",
                "login", "search", "pagination", "pager", "contentinfo", "complementary", "alert", "hidden"}
# Words that may stand beside them in one class, id or role without changing its meaning.
BESIDE_CUES = {"site", "page", "global", "main", "primary", "secondary", "top", "bottom", "left", "right", "side", "bar", "box",
               "container", "wrapper", "wrap", "inner", "outer", "block", "section", "area", "list", "item", "items", "link",
               "links", "button", "buttons", "icons", "form", "posts", "articles", "footer", "header", "content", "0"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<raw>" + "|".join(sorted(RAW)) + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?P<odd>/?[a-zA-Z][^>]*)(?:>|\Z)",
    re.S | re.I)
_CUE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)

# content: a token or a tuple of terms; constant: 0 if texts differ, else their checksum with SEVERAL if pages agree on it
Term = tuple  # (content, repeated, optional, constant)
SEVERAL = 1 << 33


def texts(page: str) -> Iterator[tuple[str, str | None]]:
    """Tokens of a page in order: (container path + "<" or ">", None) and (path/leaf + "#", block of text)."""
    path: list[str] = []
    leaf = ""
    parts: list[str] = []
    at = 0

    def block():
        words = "".join(parts).split()
        parts.clear()
        return [("/".join([*path, leaf]) + "#", " ".join(words))] if words else []

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(htmllib.unescape(page[at:m.start()]))
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            if m["odd"] is not None or m["raw"]:
                parts.append(" ")
            continue
        if name in LEAVES:
            yield from block()
            leaf = "" if m["end"] else name
        elif name in CONTAINERS:
            yield from block()
            leaf = ""
            if m["end"]:
                kind = [p.split(".")[0] for p in path]
                if name in kind:
                    while True:
                        done = path[-1].split(".")[0] == name
                        yield "/".join(path) + ">", None
                        path.pop()
                        if done:
                            break
            elif not m["attrs"].rstrip().endswith("/"):
                path.append(name + _cues(m["attrs"]))
                yield "/".join(path) + "<", None
        elif name in ("br", "hr", "img", "input", "wbr"):
            parts.append(" " if name != "wbr" else "")
    if at < len(page):
        parts.append(htmllib.unescape(page[at:]))
    yield from block()
    while path:
        yield "/".join(path) + ">", None
        path.pop()


def _cues(attrs: str) -> str:
    words = [re.sub(r"[^a-z0-9]+", "-", w).strip("-") for m in _CUE.finditer(attrs) for w in (m[1] or m[2] or m[3] or "").lower().split()]
    if _HIDDEN.search(_CUE.sub("", re.sub(r"\"[^\"]*\"|'[^']*'", "", attrs))):
        words.append("hidden")
    return "".join("." + re.sub(r"\d+", "0", w) for w in dict.fromkeys(words) if w)


def _key(term: Term):
    """What a term stands for, apart from how often."""
    c = term[0]
    return c if isinstance(c, str) else tuple(_key(t) for t in c) if len(c) > 1 else _key(c[0])


def _merge(a: Term, b: Term, seen: int = 0) -> Term:
    """Two terms with equal keys as one; ``seen``: what it adds to a constant (``SEVERAL`` for terms of different pages)."""
    while not isinstance(a[0], str) and len(a[0]) == 1:
        a = (a[0][0][0], a[1] or a[0][0][1], a[2] or a[0][0][2], a[0][0][3])
    while not isinstance(b[0], str) and len(b[0]) == 1:
        b = (b[0][0][0], b[1] or b[0][0][1], b[2] or b[0][0][2], b[0][0][3])
    content = a[0] if isinstance(a[0], str) else tuple(_merge(x, y, seen) for x, y in zip(a[0], b[0]))
    return content, a[1] or b[1], a[2] or b[2], a[3] | b[3] | seen if a[3] and (a[3] | SEVERAL) == (b[3] | SEVERAL) else 0


def fold(terms: list[Term]) -> tuple[list[Term], list[list[int]]]:
    """Adjacent repeats as repeated groups, and for every term the positions of the input under it."""
    under = [[i] for i in range(len(terms))]
    for period in range(1, LONGEST_PERIOD + 1):
        keys = [_key(t) for t in terms]
        out, spans, i = [], [], 0
        while i < len(terms):
            j = i + period
            while keys[i:i + period] == keys[j:j + period] and j + period <= len(terms):
                j += period
            if j > i + period:
                group = terms[i:i + period]
                for k in range(i + period, j, period):
                    group = [_merge(x, y) for x, y in zip(group, terms[k:k + period])]
                out.append((group[0][0], True, group[0][2], group[0][3]) if period == 1 else (tuple(group), True, False, 0))
                spans.append([p for s in under[i:j] for p in s])
                i = j
            else:
                out.append(terms[i])
                spans.append(under[i])
                i += 1
        terms, under = out, spans
    return terms, under


def page_terms(tokens: list[tuple[str, str | None]]) -> list[Term]:
    return [(t, False, False, zlib.crc32(x.encode("utf-8", "replace")) | 1 << 32 if x is not None else 1) for t, x in tokens]


def _gather(terms: list[Term], groups: set, under: list[list[int]]) -> tuple[list[Term], list[list[int]]]:
    """Single occurrences of the other side's repeated groups, as groups."""
    for g in sorted(groups, key=lambda g: (-len(g), repr(g))):
        keys = [_key(t) for t in terms]
        out, spans, i, n = [], [], 0, len(g)
        while i < len(terms):
            if tuple(keys[i:i + n]) == g:
                out.append((tuple(terms[i:i + n]), False, False, 0))
                spans.append([p for s in under[i:i + n] for p in s])
                i += n
            else:
                out.append(terms[i])
                spans.append(under[i])
                i += 1
        terms, under = out, spans
    return terms, under


def _groups(terms: list[Term]) -> set:
    return {_key(t) for t in terms if isinstance(_key(t), tuple)}


def align(a: list[Term], b: list[Term]) -> list[Term]:
    """The expression that covers both: matches merged, the rest optional."""
    ka, kb = [_key(t) for t in a], [_key(t) for t in b]
    if ka == kb:
        return [_merge(x, y, SEVERAL) for x, y in zip(a, b)]
    ga, gb = _groups(a), _groups(b)
    a = _gather(a, gb - ga, [[]] * len(a))[0]
    b = _gather(b, ga - gb, [[]] * len(b))[0]
    out: list[Term] = []
    for op, i, j, k, l in SequenceMatcher(None, [_key(t) for t in a], [_key(t) for t in b], False).get_opcodes():
        if op == "equal":
            out += [_merge(x, y, SEVERAL) for x, y in zip(a[i:j], b[k:l])]
        else:
            out += [(t[0], t[1], True, t[3]) for t in a[i:j] + b[k:l]]
    return fold(out)[0]


def _kinds(token: str) -> list[tuple[str, set[str]]]:
    return [(c.split(".")[0], set(c.split(".")[1:])) for c in token[:-1].split("/")]


def _article(token: str) -> bool:
    return any(k in ("article", "main") or k != "body" and any("main" in c.split("-") for c in cues) for k, cues in _kinds(token)[:-1])


@lru_cache(65536)
def _drops(cue: str) -> bool:
    """Whether a class, id or role as a whole marks what is not the article."""
    words = set(cue.split("-"))
    return bool(words & DROPPED_CUES) and words <= DROPPED_CUES | BESIDE_CUES


def _boilerplate(token: str, by_cues: bool = True) -> bool:
    inside = False
    for kind, cues in _kinds(token)[:-1]:
        marked = by_cues and kind not in ("html", "body") and any(map(_drops, cues))
        if kind in DROPPED or marked or kind == "header" and not inside:
            return True
        inside = inside or kind in ("article", "main")
    return False


def _texts_of(term: Term) -> Iterator[tuple[str, bool]]:
    """(text token, is it a slot) of a term and its groups."""
    if isinstance(term[0], str):
        if term[0].endswith("#"):
            yield term[0], not term[3] & SEVERAL
    else:
        for t in term[0]:
            for token, slot in _texts_of(t):
                yield token, slot or term[1]


def judge(terms: list[Term], pages: int) -> list[set[str]]:
    """For each term of a wrapper, the text tokens under it that belong to the article."""
    found = [[(t, s or term[1]) for t, s in _texts_of(term)] for term in terms]
    good = [[(t, s) for t, s in f if not _boilerplate(t)] for f in found]
    if any(_article(t) for f in good for t, _ in f):
        good = [[(t, s) for t, s in f if _article(t)] for f in good]
    elif pages > 1 and any(s for f in good for _, s in f):
        good = [[(t, s) for t, s in f if s] for f in good]
    return [{t for t, _ in f} for f in good]


def dump(terms: list[Term]) -> str:
    return json.dumps(terms, separators=(",", ":"))


def load(text: str) -> list[Term]:
    deep = lambda x: tuple(deep(y) for y in x) if isinstance(x, list) else x
    return [deep(t) for t in json.loads(text)]


@lru_cache(4096)
def _judged(wrapper: str, pages: int) -> tuple[list, set, list[set[str]]]:
    terms = load(wrapper)
    return [_key(t) for t in terms], _groups(terms), judge(terms, pages)


def extract(page: str | None, wrapper: str | None, pages: int = 1) -> str:
    """The page's article under its host's wrapper, blocks joined by an empty line."""
    tokens = list(texts(page or ""))
    if not any(x for _, x in tokens):
        return ""
    terms, under = fold(page_terms(tokens))
    if wrapper is None:
        wrapper, pages = dump(terms), 1
    keys, groups, kept = _judged(wrapper, pages)
    terms, under = _gather(terms, groups - _groups(terms), under)
    own = [_key(t) for t in terms]
    matched: dict[int, int] = {}
    if own == keys:
        matched = {i: i for i in range(len(keys))}
    else:
        for i, k, n in SequenceMatcher(None, own, keys, False).get_matching_blocks():
            matched.update((i + d, k + d) for d in range(n))
    everywhere = set().union(*kept) if kept else set()
    keep = set()
    for i, positions in enumerate(under):
        allowed = kept[matched[i]] if i in matched else everywhere
        keep.update(p for p in positions if tokens[p][1] is not None and tokens[p][0] in allowed)
    if not keep:  # a page unlike its host's others (without their article) speaks for itself
        own_texts = [p for p, (t, x) in enumerate(tokens) if x is not None and not _boilerplate(t)]
        own_texts = own_texts or [p for p, (t, x) in enumerate(tokens) if x is not None and not _boilerplate(t, False)]
        keep = {p for p in own_texts if _article(tokens[p][0])} or set(own_texts)
    return "\n\n".join(tokens[p][1] for p in sorted(keep))


def host_of(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def infer_wrappers(pages: DataFrame, url: str = "url", html: str = "html", fan: int = FAN) -> DataFrame:
    """(host, wrapper, pages): the union-free expression of every host."""
    bounded_batches(pages.sparkSession)
    narrow = pages.select(host_of(url).alias("host"), col(html).cast("string").alias("html")).where("html is not null")
    schema = "host string, wrapper string, pages long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known: dict[str, tuple[list[Term], int]] = {}
            for host, page in zip(b.column(0).to_pylist(), b.column(1)):
                terms = fold(page_terms(list(texts(page.as_py()))))[0]
                if host in known:
                    known[host] = align(known[host][0], terms), known[host][1] + 1
                else:
                    known[host] = terms, 1
            yield pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()),
                                              pa.array([dump(t) for t, _ in known.values()], pa.string()),
                                              pa.array([n for _, n in known.values()], pa.int64())], ["host", "wrapper", "pages"])

    def meet(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["wrapper", "pages"])
        terms = load(group["wrapper"].iloc[0])
        for w in group["wrapper"].iloc[1:]:
            terms = align(terms, load(w))
        return pd.DataFrame({"host": [key[0]], "wrapper": [dump(terms)], "pages": [int(group["pages"].sum())]})

    part = stage(narrow.mapInArrow(run, schema), "wrapper-parts")
    while True:
        most = part.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return part
        buckets = -(-most // fan)
        spread = F.pmod(F.xxhash64("wrapper", "pages", F.monotonically_increasing_id()), F.lit(buckets))
        part = stage(part.withColumn("bucket", spread).groupBy("host", "bucket").applyInPandas(meet, schema), "wrapper-parts")


def extract_articles(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points)."""
    need(pages, id_col, url, html)
    wrappers = infer_wrappers(pages, url, html).withColumnRenamed("host", "w_host")
    narrow = pages.select(col(id_col).alias("page_id"), col(url).alias("url"), host_of(url).alias("host"),
                          col(html).cast("string").alias("html"))
    j = narrow.join(wrappers, F.col("host") == F.col("w_host"), "left").select("page_id", "url", "html", "wrapper", "pages")
    schema = narrow.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [extract(h.as_py(), w.as_py(), n.as_py() or 1) for h, w, n in zip(b.column(2), b.column(3), b.column(4))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()),
                                              pa.array([len(x) for x in out], pa.int64())], schema.names)

    return j.mapInArrow(run, schema)
