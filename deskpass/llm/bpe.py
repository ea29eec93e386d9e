"""BPE encoding and decoding by forced-boundary splitting.

A merge joins two neighbouring symbols to a token of the vocabulary, so two bytes that are
neighbours inside no token can never be merged across: between them every word has a certain
cut. A table of all byte pairs (256 x 512: a word's last byte is a symbol of its own, as it
carries the word-end mark) says where these cuts are; words fall apart at them, the fragments
are encoded independently of each other by merges in order of rank, and a word's ids are its
fragments' ids one after the other. A run without spaces, of any length, so becomes many
short fragments; equal fragments and words are encoded once per Python worker.

Text is normalised and cut into words as the vocabulary file says: characters whose
treatment is plain (ASCII, the letters of Latin-1, dashes and quotation marks) by a pattern
here, words with others by the file's own normaliser and splitter. Added tokens inside a text
are cut out first and are one id each. Decoding writes the ids' tokens one after the other
with a space between, as the library does for a file without a decoder.

Both directions are one pass over the rows where they lie: no shuffle. Long texts are
taken in parts of about ``AT_ONCE`` characters, so they need little more than themselves and their ids.

Defined cases: null text has no ids (an empty list) and decodes to empty text; null ids decode to null;
rows are encoded one by one, repeated or not; an id outside the vocabulary raises; an empty
table gives no rows; columns called ids or decoded are replaced.
"""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskpass.llm.common import bounded_batches, col, need

REMEMBERED = 150_000  # words, and as many fragments, per Python worker
SHORT = 64            # length of a word or fragment worth remembering
ROWS = 256            # texts whose ids are held at once
AT_ONCE = 1 << 19     # characters whose words are listed at once

# The byte-level alphabet's printable bytes (the others stand as the code
# points from 256 on, in order) and the vocabulary's word-end mark.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
WORD_END = "</w>"
# Characters that normalise to themselves in lower case, one by one, and whose class is plain.
_PLAIN = "\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff‐-‧"
_ODD = re.compile(f"[^{_PLAIN}]")
_LETTER = "a-z\xdf-\xf6\xf8-\xff"
# The vocabulary's word pattern (contractions, letters, single digits, other runs) over lower-cased plain text.
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^ \t-\r{_LETTER}0-9]+")
_RUNS, _SPACE = re.compile("[^ \t-\r]+"), re.compile("[ \t-\r]")


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class Bpe:
    """Ids of words from the vocabulary's merges, fragment by fragment."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary = model["vocab"]
        others = [b for b in range(256) if b not in set(PRINTABLE)]
        letter = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.byte = {c: b for b, c in letter.items()}
        # symbols: a byte, or 256 + a byte that ends its word
        self.first = np.array([vocabulary[letter[b]] for b in range(256)] + [vocabulary[letter[b] + WORD_END] for b in range(256)])
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(pairs)}
        table = np.array(sorted((a << 16 | b, rank, new) for (a, b), (rank, new) in self.merges.items()), np.int64).reshape(-1, 3)
        self.pairs, self.ranks, self.made = table.T.copy()
        self.certain = np.ones((256, 512), bool)
        for token in vocabulary:
            s = self.symbols(token)
            self.certain[[x & 255 for x in s[:-1]], s[1:]] = False
        added = self.library.get_added_tokens_decoder()
        self.added = {t.content: np.array([i], "<u4").tobytes() for i, t in added.items()}
        self.cut_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")" if added else r"(?!)")
        self.words: dict[str, bytes] = {}
        self.fragments: dict[bytes, bytes] = {}

    def symbols(self, token: str) -> list[int]:
        ends = token.endswith(WORD_END)
        s = [self.byte[c] for c in (token[:-len(WORD_END)] if ends else token)]
        return [*s[:-1], s[-1] + 256] if ends and s else s

    def merged(self, block: np.ndarray) -> list[bytes]:
        """Ids of equally long fragments (rows of symbols), all at once: in every row the cheapest pair is merged,
        the leftmost of equals, until none is left."""
        ids, rows = self.first[block], np.arange(len(block))
        out: list[bytes] = [b""] * len(block)
        while ids.shape[1] > 1 and len(rows):
            pairs = ids[:, :-1] << 16 | ids[:, 1:]
            at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
            rank = np.where(self.pairs[at] == pairs, self.ranks[at], len(self.pairs))
            best = rank.argmin(axis=1)
            each = np.arange(len(rows))
            going = rank[each, best] < len(self.pairs)
            for r, x in zip(rows[~going].tolist(), ids[~going].astype("<u4")):
                out[r] = x.tobytes()
            new = self.made[at[each, best]][going]
            ids, rows, best = ids[going], rows[going], best[going]
            places = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, places + (places > best[:, None]), axis=1)
            ids[np.arange(len(rows)), best] = new
        for r, x in zip(rows.tolist(), ids.astype("<u4")):
            out[r] = x.tobytes()
        return out

    def learn_fragments(self, fragments: set[bytes]) -> None:
        by_length: dict[int, list[bytes]] = {}
        for f in fragments:
            by_length.setdefault(len(f) // 2, []).append(f)
        for n, own in by_length.items():
            if n > SHORT:
                for f in own:
                    self.fragments[f] = self.merged_by_heap(self.first[np.frombuffer(f, np.int16)].tolist())
                continue
            for k in range(0, len(own), 8192):
                part = own[k:k + 8192]
                self.fragments.update(zip(part, self.merged(np.frombuffer(b"".join(part), np.int16).reshape(-1, n))))

    def merged_by_heap(self, ids: list[int]) -> bytes:
        """The same for one long fragment, in n log n steps."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        found = [(*m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heap = [(rank, i, new, a, b) for rank, new, i, a, b in found]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged since
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (m := self.merges.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, m[1], ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of the given words (byte-level cut at certain boundaries, fragments encoded, ids joined)."""
        raw = [w.encode("utf-8", "replace") for w in words]
        joined = np.frombuffer(b"".join(raw), np.uint8).astype(np.int16)
        ends = np.cumsum([len(b) for b in raw])
        joined[ends - 1] += 256
        cuts = self.certain[joined[:-1] & 255, joined[1:]]
        cuts[ends[:-1] - 1] = True
        ends = np.flatnonzero(np.append(cuts, True)) + 1
        starts = np.append(0, ends[:-1])
        is_end = joined[ends - 1] >= 256
        keys = [joined[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist())]
        fresh = set(keys).difference(self.fragments)
        if len(self.fragments) + len(fresh) > REMEMBERED:
            self.fragments.clear()
            fresh = set(keys)
        self.learn_fragments(fresh)
        out, own, w = {}, [], 0
        for ids, last in zip(map(self.fragments.__getitem__, keys), is_end.tolist()):
            own.append(ids)
            if last:
                out[words[w]] = b"".join(own)
                own, w = [], w + 1
        for f in fresh:
            if len(f) > 2 * SHORT:
                del self.fragments[f]
        return out

    def odd_words(self, run: str) -> list[str]:
        """Words of a text that has other than plain characters, by the file's own normaliser and splitter."""
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(run))
        return [bytes(map(self.byte.__getitem__, w)).decode("utf-8") for w, _ in cut]

    def words_of(self, text: str) -> list[str]:
        if not _ODD.search(text):
            return _WORDS.findall(text.lower())
        out = []
        for run in _RUNS.findall(text):
            out += self.odd_words(run) if _ODD.search(run) else _WORDS.findall(run.lower())
        return out

    def plain_ids(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without added tokens, together not much longer than ``AT_ONCE`` characters."""
        words = [self.words_of(t) for t in texts]
        new = set().union(*words).difference(self.words)
        if len(self.words) + len(new) > REMEMBERED:
            self.words.clear()
            new = set().union(*words)
        if new:
            self.words |= self.learn(list(new))
        out = [b"".join(map(self.words.__getitem__, own)) for own in words]
        for w in new:
            if len(w) > SHORT:
                del self.words[w]
        return out

    def parts(self, text: str) -> Iterator[str]:
        """A text cut at spaces into parts of about ``AT_ONCE`` characters (one run without spaces is one part)."""
        at = 0
        while len(text) - at > 2 * AT_ONCE and (space := _SPACE.search(text, at + AT_ONCE)):
            yield text[at:space.start()]
            at = space.start()
        yield text[at:]

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of every text as little-endian 32-bit words."""
        waiting, size = [], 0
        for t in texts:
            if len(t) > AT_ONCE or any(a in t for a in self.added):
                yield from self.plain_ids(waiting)
                waiting, size = [], 0
                cut = self.cut_added.split(t)
                yield b"".join(self.added.get(p) or b"".join(b"".join(self.plain_ids([x])) for x in self.parts(p)) for p in cut)
                continue
            waiting.append(t)
            size += len(t)
            if size > AT_ONCE:
                yield from self.plain_ids(waiting)
                waiting, size = [], 0
        yield from self.plain_ids(waiting)

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))


def decode(tokens: list[str], ids: bytes) -> str:
    """Text of packed ids: their tokens with a space between."""
    return " ".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_tokens(path: str) -> list[str]:
    """The vocabulary file's tokens, added ones too, by id."""
    import json
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    by_id = {i: t for t, i in whole["model"]["vocab"].items()} | {t["id"]: t["content"] for t in whole["added_tokens"]}
    return [by_id.get(i, "") for i in range(max(by_id) + 1)]


_BPES: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    if path not in _BPES:
        _BPES[path] = Bpe(path)
    return _BPES[path]


def _with(df: DataFrame, source: str, targets: dict[str, str], maker) -> DataFrame:
    """``df`` with the columns ``targets`` (name: type) made from the values of ``source``, a few rows at a time."""
    kept = df.select(*[col(c) for c in df.columns if c.lower() not in targets or c == source])
    place = kept.columns.index(source)
    same = source.lower() in targets
    schema = (kept.drop(source) if same else kept).select("*").schema
    for name, kind in targets.items():
        schema = schema.add(name, kind)
    types = {"binary": pa.binary(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = maker()
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                part = b.slice(k, ROWS)
                made = [pa.array(x, types[kind]) for x, kind in zip(make(part.column(place).to_pylist()), targets.values())]
                yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(part.columns) if not same or i != place], *made], schema.names)

    return kept.mapInArrow(run, schema)


def encode_texts(docs: DataFrame, text: str = "text", vocabulary: str | None = None, decoded: bool = False) -> DataFrame:
    """``docs`` with ids: the whole text's ids as little-endian unsigned 32-bit integers; ``decoded``: with decoded
    too, the text that these ids stand for, in the same pass."""
    need(docs, text)
    bounded_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    def encoder():
        own = bpe(path)
        tokens = read_tokens(path) if decoded else []

        def make(texts: list[str | None]) -> list[list]:
            ids = list(own.encode_all([t or "" for t in texts]))
            return [ids, [decode(tokens, x) for x in ids]] if decoded else [ids]

        return make

    return _with(docs.withColumn(text, col(text).cast("string")), text, {"ids": "binary"} | ({"decoded": "string"} if decoded else {}), encoder)


def decode_ids(df: DataFrame, ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``df`` with decoded: the text that the ids stand for."""
    need(df, ids)
    bounded_batches(df.sparkSession)
    path = vocabulary or default_vocabulary()

    def decoder():
        tokens = read_tokens(path)
        return lambda rows: [[None if x is None else decode(tokens, x) for x in rows]]

    return _with(df, ids, {"decoded": "string"}, decoder)


def token_digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    need(docs, id_col, text)
    narrow = docs.select(col(id_col).alias("doc_id"), col(text).cast("string").alias("text"))
    return encode_texts(narrow, vocabulary=vocabulary, decoded=True).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
