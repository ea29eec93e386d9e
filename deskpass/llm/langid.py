"""Language ID by segmentation-marginalised unigrams over a fixed public vocabulary.

A word's probability in a language is the sum, over all ways to cut it into pieces
of a public byte-level vocabulary, of the product of the pieces' probabilities; a
forward pass sums them without listing any. Piece probabilities are learned by EM
(forward-backward expected counts) from a sample of labelled documents; a text's
score is the posterior of the best language, all languages equally likely before.

Learning: ``sample_docs`` documents a language (a documented bound of the sample,
drawn by the hash of the id; fewer if the language has fewer). Words are counted by
Spark, expected counts are summed per task and piece, and only the table languages x
pieces (bounded by the vocabulary) reaches the driver. Prediction is one pass over
whole texts, no shuffle; words seen before are looked up.

Defined cases: null text or text without a letter is ``und`` with score 0, and so is
any text if no language could be learned; documents without an id or a language are
predicted, never learned from; equal scores go to the first language in name order;
a letter is a character of Unicode's category L; runs of letters of any length are summed over all
their segmentations; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskpass.llm.common import bounded_batches, col, need, stage

SAMPLE_DOCS = 2000   # labelled documents learned from, a language
EM_ROUNDS = 3
SMOOTHING = 0.05     # expected count added to every piece
AT_ONCE = 32         # bytes of words that are summed many at a time; longer ones one by one, with rescaling
LEARN_LONGEST = 4096  # bytes of the longest words learned from (a bound of the sample; any length is scored)
POSITIONS = 1 << 16  # positions of a long word whose pieces are looked up at once
REMEMBERED = 300_000  # words per Python worker
DOCS_AT_ONCE = 128
UNKNOWN = "und"
FOLDS, HELD_OUT_FOLD = 5, 0

_LETTERS = re.compile(r"[^\W\d_]+")  # letters, and number signs that are cut out afterwards
_BASE = np.uint64(0x9E3779B97F4A7C15)  # any odd number: prefix hashes are polynomials in it


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_pieces(path: str) -> list[bytes]:
    """The vocabulary's pieces that can occur in a word: a space first or nowhere, no ASCII but letters."""
    import base64
    pieces = []
    with open(path, "rb") as f:
        for line in f:
            p = base64.b64decode(line.split()[0])
            body = p[1:] if p[:1] == b" " else p
            if body and all(c >= 128 or 97 <= c <= 122 for c in body):
                pieces.append(p)
    return pieces


def words_of(text: str) -> list[bytes]:
    """Lower-cased letter runs, each after a space."""
    out = []
    for w in _LETTERS.findall(text.lower()):
        for x in [w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split():
            out.append(b" " + x.encode("utf-8", "replace"))
    return out


def _prefix_hashes(block: np.ndarray) -> np.ndarray:
    h = np.zeros((block.shape[1] + 1, block.shape[0]), np.uint64)
    for j in range(block.shape[1]):
        h[j + 1] = h[j] * _BASE + block[:, j].astype(np.uint64) + np.uint64(1)
    return h


class Lattice:
    """Finds the vocabulary's pieces in many words at once; forward and backward sums over their segmentations."""

    def __init__(self, pieces: list[bytes]):
        hashes = np.array([int(_prefix_hashes(np.frombuffer(p, np.uint8)[None, :])[-1, 0]) for p in pieces], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.lengths = sorted(set(map(len, pieces)))
        self.longest = self.lengths[-1]
        self.powers = np.array([pow(int(_BASE), i, 1 << 64) for i in range(self.longest + 1)], np.uint64)

    def edges(self, block: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, words, pieces): which words of the equally long ``block`` have which piece there."""
        h = _prefix_hashes(block)
        out = []
        for end in range(1, block.shape[1] + 1):
            for length in self.lengths:
                if length > end:
                    break
                want = h[end] - h[end - length] * self.powers[length]
                i = np.minimum(np.searchsorted(self.hashes, want), len(self.hashes) - 1)
                rows = np.flatnonzero(self.hashes[i] == want)
                if len(rows):
                    out.append((end - length, end, rows, self.order[i[rows]]))
        return out

    def long_edges(self, word: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(end, starts, pieces) at every position of one word, in order."""
        c = np.frombuffer(word, np.uint8)
        h = np.empty(len(c) + 1, np.uint64)
        h[0], total = 0, 0
        for i, x in enumerate(word):
            total = (total * int(_BASE) + x + 1) & 0xFFFFFFFFFFFFFFFF
            h[i + 1] = total
        for first in range(1, len(c) + 1, POSITIONS):
            ends = np.arange(first, min(first + POSITIONS, len(c) + 1))
            found = []
            for length in self.lengths:
                own = ends[ends >= length]
                want = h[own] - h[own - length] * self.powers[length]
                i = np.minimum(np.searchsorted(self.hashes, want), len(self.hashes) - 1)
                hit = self.hashes[i] == want
                found.append((own[hit], np.full(int(hit.sum()), length), self.order[i[hit]]))
            end, length, piece = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(end, kind="stable")
            end, length, piece = end[order], length[order], piece[order]
            cuts = np.searchsorted(end, ends)
            for e, a, b in zip(ends.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(end)]):
                yield e, e - length[a:b], piece[a:b]

    def long_log_likelihood(self, word: bytes, p: np.ndarray) -> np.ndarray:
        """The same sum for one word of any length: only the last sums are kept, rescaled as they shrink."""
        held = self.longest + 1
        alpha, scale = np.zeros((held, p.shape[1])), np.zeros(p.shape[1])
        alpha[0] = 1
        for end, starts, pieces in self.long_edges(word):
            alpha[end % held] = (alpha[starts % held] * p[pieces]).sum(axis=0)
            if end % 8 == 0:
                most = alpha.max(axis=0)
                most[most == 0] = 1
                alpha /= most
                scale += np.log(most)
        return scale + np.log(np.maximum(alpha[len(word) % held], 1e-300))

    def log_likelihood(self, words: list[bytes], p: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language; ``p`` is pieces x languages."""
        out = np.empty((len(words), p.shape[1]))
        for n, at in _by_length(words):
            if n > AT_ONCE:
                for i in at:
                    out[i] = self.long_log_likelihood(words[i], p)
                continue
            block = np.frombuffer(b"".join([words[i] for i in at]), np.uint8).reshape(len(at), n)
            alpha = np.zeros((n + 1, len(at), p.shape[1]))
            alpha[0] = 1
            for start, end, rows, pieces in self.edges(block):
                alpha[end][rows] += alpha[start][rows] * p[pieces]
            out[at] = np.log(np.maximum(alpha[n], 1e-300))
        return out

    def long_expected(self, word: bytes, weight: float, p: np.ndarray, out: np.ndarray) -> None:
        """Adds one long word's expected piece counts to ``out``, in logarithms."""
        n = len(word)
        log_p = np.log(p)
        alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        alpha[0] = beta[n] = 0
        edges = [e for e in self.long_edges(word) if len(e[1])]
        for end, starts, pieces in edges:
            alpha[end] = np.logaddexp.reduce(alpha[starts] + log_p[pieces])
        for end, starts, pieces in reversed(edges):
            beta[starts] = np.logaddexp(beta[starts], beta[end] + log_p[pieces])
        if np.isfinite(alpha[n]):
            for end, starts, pieces in edges:
                np.add.at(out, pieces, weight * np.exp(alpha[starts] + log_p[pieces] + beta[end] - alpha[n]))

    def expected(self, words: list[bytes], weights: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected piece counts of the weighted words under one language's ``p``."""
        out = np.zeros(len(p))
        for n, at in _by_length(words):
            if n > AT_ONCE:
                for i in at:
                    self.long_expected(words[i], weights[i], p, out)
                continue
            block = np.frombuffer(b"".join([words[i] for i in at]), np.uint8).reshape(len(at), n)
            edges = self.edges(block)
            alpha, beta = np.zeros((n + 1, len(at))), np.zeros((n + 1, len(at)))
            alpha[0] = beta[n] = 1
            for start, end, rows, pieces in edges:
                alpha[end][rows] += alpha[start][rows] * p[pieces]
            for start, end, rows, pieces in sorted(edges, key=lambda e: -e[0]):
                beta[start][rows] += beta[end][rows] * p[pieces]
            scale = weights[at] / np.maximum(alpha[n], 1e-300)
            for start, end, rows, pieces in edges:
                out += np.bincount(pieces, alpha[start][rows] * p[pieces] * beta[end][rows] * scale[rows], len(p))
        return out


def _by_length(words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
    at: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        at.setdefault(len(w), []).append(i)
    for n, rows in at.items():
        for k in range(0, len(rows), 20_000):
            yield n, rows[k:k + 20_000]


_LATTICES: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    if path not in _LATTICES:
        _LATTICES[path] = Lattice(read_pieces(path))
    return _LATTICES[path]


def fold_of(id_col: str) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(col(id_col).cast("string").cast("binary")) % FOLDS


def training_words(docs: DataFrame, id_col: str, text: str, lang: str, sample_docs: int) -> DataFrame:
    """(lang, word, n) over about ``sample_docs`` documents a language, by hash of the id, off the held-out fold."""
    labelled = docs.where((fold_of(id_col) != HELD_OUT_FOLD) & col(lang).isNotNull() & col(text).isNotNull())
    # written first: a table of known (small) size is broadcast, and texts are not shuffled by language
    sizes = stage(labelled.groupBy(col(lang).alias("s_lang")).agg(F.count(F.lit(1)).alias("docs")), "langid-sizes")
    share = F.pmod(F.xxhash64(col(id_col).cast("string")), F.lit(1 << 30)) / float(1 << 30)
    picked = (labelled.select(col(lang).alias("lang"), col(text).cast("string").alias("text"), share.alias("share"))
              .join(sizes, F.col("lang") == F.col("s_lang")).where(F.col("share") * F.col("docs") < sample_docs))
    schema = "lang string, word binary, n long"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            counts: dict[tuple[str, bytes], int] = {}
            for name, t in zip(f["lang"], f["text"]):
                for w in words_of(t):
                    if len(w) <= LEARN_LONGEST:
                        counts[name, w] = counts.get((name, w), 0) + 1
            if counts:
                yield pd.DataFrame({"lang": [k[0] for k in counts], "word": [k[1] for k in counts], "n": list(counts.values())})

    counted = picked.select("lang", "text").mapInPandas(run, schema)
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
          vocabulary: str | None = None, sample_docs: int = SAMPLE_DOCS, rounds: int = EM_ROUNDS) -> tuple[list[str], np.ndarray]:
    """(languages in name order, piece probabilities: pieces x languages)."""
    path = vocabulary or default_vocabulary()
    bounded_batches(docs.sparkSession)
    words = stage(training_words(docs, id_col, text, lang, sample_docs), "langid-words")
    names = sorted(r[0] for r in words.select("lang").distinct().collect())
    n_pieces = len(read_pieces(path))
    p = np.full((n_pieces, max(1, len(names))), 1 / n_pieces)
    spark = docs.sparkSession
    for _ in range(rounds if names else 0):
        shared = spark.sparkContext.broadcast((names, p))  # bounded by languages x vocabulary

        def step(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            known, prob = shared.value
            lat = lattice(path)
            total = np.zeros(prob.shape)
            for f in frames:
                for k, name in enumerate(known):
                    own = f[f["lang"] == name]
                    if len(own):
                        total[:, k] += lat.expected(list(own["word"]), own["n"].to_numpy(float), prob[:, k])
            pieces, k = np.nonzero(total)
            yield pd.DataFrame({"lang": k.astype("int32"), "piece": pieces.astype("int32"), "n": total[pieces, k]})

        sums = (words.mapInPandas(step, "lang int, piece int, n double")
                .groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas())
        counts = np.full(p.shape, SMOOTHING)
        counts[sums["piece"].to_numpy(), sums["lang"].to_numpy()] += sums["n"].to_numpy()
        p = counts / counts.sum(axis=0)
        shared.unpersist()
    return names, p


class _Scorer:
    def __init__(self, path: str, names: list[str], p: np.ndarray):
        self.lattice, self.names, self.p = lattice(path), names, p
        self.forget()

    def forget(self) -> None:
        self.row: dict[bytes, int] = {}
        self.scores = np.empty((0, self.p.shape[1]))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        words = [words_of(t) if t else [] for t in texts]
        new = set().union(*words).difference(self.row) if words else set()
        if len(self.row) + len(new) > REMEMBERED:
            self.forget()
            new = set().union(*words)
        if new and self.names:
            fresh = sorted(new)
            self.row.update(zip(fresh, range(len(self.row), len(self.row) + len(fresh))))
            self.scores = np.concatenate([self.scores, self.lattice.log_likelihood(fresh, self.p)])
        langs, scores = [], []
        for own in words:
            if not own or not self.names:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            total = self.scores[np.fromiter(map(self.row.__getitem__, own), np.int64, len(own))].sum(axis=0)
            best = int(total.argmax())
            langs.append(self.names[best])
            scores.append(float(1 / np.exp(np.maximum(total - total[best], -700)).sum()))
        return langs, scores


def predictor(docs: DataFrame, names: list[str], p: np.ndarray, vocabulary: str | None = None):
    """A column function text -> struct(lang, score)."""
    path = vocabulary or default_vocabulary()
    shared = docs.sparkSession.sparkContext.broadcast((names, p))

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(path, *shared.value)
        for texts in batches:
            langs, scores = [], []
            values = [t if isinstance(t, str) else None for t in texts]
            for i in range(0, len(values), DOCS_AT_ONCE):
                l, s = scorer.predict(values[i:i + DOCS_AT_ONCE])
                langs += l
                scores += s
            yield pd.DataFrame({"lang": pd.Series(langs, dtype=object), "score": pd.Series(scores, dtype="float64")})

    return predict


def identify(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
             vocabulary: str | None = None, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    need(docs, id_col, text, lang)
    names, p = learn(docs, id_col, text, lang, vocabulary, sample_docs)
    predict = predictor(docs, names, p, vocabulary)
    held = F.coalesce(fold_of(id_col) == HELD_OUT_FOLD, F.lit(False))
    return (docs.select(col(id_col).alias("doc_id"), held.alias("held_out"), predict(col(text).cast("string")).alias("p"))
            .select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score")))


def language_filter(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
                    vocabulary: str | None = None, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``docs`` without those of no known language (``und``) or a score below ``least``; one pass, no shuffle of text."""
    need(docs, id_col, text, lang)
    names, p = learn(docs, id_col, text, lang, vocabulary, sample_docs)
    predict = predictor(docs, names, p, vocabulary)
    got = predict(col(text).cast("string"))
    kept = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("d"), got.alias("p"))
    return kept.where((F.col("p.lang") != UNKNOWN) & (F.col("p.score") >= least)).select("d.*")
