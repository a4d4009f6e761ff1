"""Operator 7: toxicity by noisy-channel deobfuscation.

A written word may be a clean word sent through a noisy channel that swaps
letters for look-alikes (leetspeak), stretches letters and drives separators
between them.  Suspicious stretches of a text become a character lattice: each
written character may stand for itself, for the letters it imitates, for a
repetition of the one before, or for nothing (a separator); a separator may
also be a gap between words, so that one stretch may hold several; a Viterbi search
under a character trigram model picks the likeliest clean word.  All other
words have a lattice of one path and stay as they are.  The restored words are
then scored: words that mark toxic documents carry log-odds weights, and a
logistic curve over their sum turns evidence into a probability.

What is learned, and from what: the character model counts trigrams of all
documents of the training fold; word weights and the curve come from at most
``TRAIN_ROWS`` labelled training rows, chosen by a hash of their id.  Copies and
near copies among them share one vote, and the curve is fitted on evidence
whose weights the other half of the texts gave.

Defined results: null and empty texts have no evidence and get the base rate's
score; without labels, or with one class only, the score is that class's
share (0.5 without labels); repeated rows are scored one by one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorlint.llm.common import fold
from vectorlint.llm.words import mix, shingles, word_hashes

#: Labelled rows that the weights are fitted on, at most (about).
TRAIN_ROWS = 12_000
#: Candidate words, at most, and toxic training rows that one must be in.
MAX_WORDS = 20_000
MIN_TOXIC_ROWS = 3
#: A word gets weight if so many toxic texts (copies count as one) have it and
#: if one standard deviation below its count it is still so many times likelier
#: in toxic than in other texts.
LEAST_TEXTS, LEAST_LIFT = 4, 10
#: Score from which a document counts as toxic.
THRESHOLD = 0.7

# Look-alikes of letters.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
SEPARATORS = " .-_*~'/\\,:;#%&"
#: Channel costs (natural log): an imitated letter, a dropped separator, a
#: repetition dropped from a stretch of three or more, a lone sign dropped.
_SWAP, _DROP, _REPEAT, _LONE = -0.7, -0.4, -0.3, -5.0
_ALPHABET = "\0abcdefghijklmnopqrstuvwxyzßàáâäçèéêëìíîïñòóôöùúûüœæ"
_CODE = {c: i for i, c in enumerate(_ALPHABET)}
_N = len(_ALPHABET) + 1                   # one more for any other letter

_LETTER = r"[^\W\d_]"
_ANY = rf"(?:{_LETTER}|[{re.escape(''.join(LEET))}])"
_WORDS = re.compile(rf"{_LETTER}+").findall
_STRETCHED = re.compile(rf"({_LETTER})\1\1").search
#: One or more look-alikes beside letters; single letters set apart by separators, in a token or over several.
_MIXED = re.compile(rf"{_ANY}+").findall
_APART = re.compile(rf"{_ANY}(?:[.\-_*~/]{{1,2}}{_ANY}){{2,}}").fullmatch
_SPACED = re.compile(rf"(?<!\S){_ANY}(?: {{1,2}}{_ANY}(?!\S)){{2,}}")
_EDGE = ".,;:?\"'()[]{}<>|&%#*-_~/\\"
_NOISE = re.compile(r"^([!$@+|])\1+|([!$@+|])\2+$|!$").sub


def _text_codes(text: str) -> np.ndarray:
    """Letters of a lower-cased text by number; 0 for a gap."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    return _table()[np.minimum(codes, 0x17F)]


_TABLE: list[np.ndarray] = []


def _table() -> np.ndarray:
    if not _TABLE:
        t = np.zeros(0x180, np.int64)
        for c in range(0x180):
            t[c] = _CODE.get(chr(c).lower(), _N - 1 if chr(c).isalpha() else 0) if c else 0
        _TABLE.append(t)
    return _TABLE[0]


def trigram_counts(texts: DataFrame) -> np.ndarray:
    """Letter trigram counts of all (text) rows, an array of fixed size; each
    task sends one row per trigram that it saw."""

    def count(batches):
        total = np.zeros(_N ** 3, np.int64)
        for b in batches:
            for t in b.column("text").to_pylist():
                if t:
                    c = np.concatenate([[0, 0], _text_codes(t), [0]])
                    k = (c[:-2] * _N + c[1:-1]) * _N + c[2:]
                    # Three or more single letters in a row are spaced words, which say nothing about gaps.
                    lone = (c[:-2] == 0) & (c[1:-1] != 0) & (c[2:] == 0)
                    three = np.flatnonzero(lone[:-4] & lone[2:-2] & lone[4:])
                    if len(three):
                        keep = np.ones(len(k), bool)
                        keep[np.minimum(three[:, None] + np.arange(5), len(k) - 1)] = False
                        k = k[keep]
                    np.add.at(total, k, 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["k", "n"])

    rows = texts.select("text").where("text IS NOT NULL").mapInArrow(count, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(_N ** 3)
    for r in rows:
        out[r.k] = r.n
    return out.reshape(_N, _N, _N)


@dataclass
class Restorer:
    """Viterbi decoding under a trigram model."""

    logp: list = field(repr=False)       # [a][b][c] -> log P(c | a b)
    memo: dict = field(default_factory=dict, repr=False)

    @classmethod
    def of(cls, counts: np.ndarray) -> Restorer:
        one = (counts.sum((0, 1)) + 1) / (counts.sum() + _N)
        two = (counts.sum(0) + 5 * one) / (counts.sum((0, 2))[:, None] + 5)
        three = (counts + 5 * two[None]) / (counts.sum(2)[:, :, None] + 5)
        return cls(np.log(three).astype(np.float32).tolist())

    def word(self, written: str) -> str:
        """The likeliest clean reading of a written stretch (lower case): a word, or several parted by blanks."""
        # A state is the last two letters (0: a gap); it keeps its best log-probability and reading (a chain of letters).
        states = {(0, 0): (0.0, None)}
        last = None
        for i, c in enumerate(written):
            options = []                 # (letter, blank or "", channel cost)
            run = written[max(0, i - 2):i + 3]
            stretched = c * 3 in run
            for x in c if c.isalpha() else LEET.get(c, ""):
                cost = 0.0 if c.isalpha() else _SWAP
                options.append((x, cost))
                if x == last and stretched:
                    options.append(("", cost + _REPEAT))
            if not c.isalpha():
                options.append(("", _DROP if c in SEPARATORS or c * 2 in run else _LONE))
            if c in SEPARATORS:
                options.append((" ", 0.0))
            after: dict = {}
            for (a, b), (p, read) in states.items():
                for x, cost in options:
                    if x == " " and not b:
                        continue         # one gap is enough
                    if x:
                        k = 0 if x == " " else _CODE.get(x, _N - 1)
                        new, q, r = (b, k), p + cost + self.logp[a][b][k], (read, x)
                    else:
                        new, q, r = (a, b), p + cost, read
                    if new not in after or q > after[new][0]:
                        after[new] = (q, r)
            states, last = after, (c if c.isalpha() else LEET.get(c, "")[:1] or last)
        _, read = max(((p + (self.logp[a][b][0] if b else 0.0), r) for (a, b), (p, r) in states.items()), key=lambda s: s[0])
        letters = []
        while read:
            read, x = read
            letters.append(x)
        return "".join(reversed(letters)).strip()

    def token(self, token: str) -> tuple[str, ...]:
        """Words of a blank-delimited lower-case token: as written, then restored."""
        got = self.memo.get(token)
        if got is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            got = self.memo[token] = self._token(token)
        return got

    def _token(self, token: str) -> tuple[str, ...]:
        core = _NOISE("", token.strip(_EDGE)).strip(_EDGE)
        if core.isalpha() and not _STRETCHED(core):
            return (core,)
        written = _WORDS(token)
        if not written:
            return ()
        if _APART(core):
            return (*written, *self.word(core).split())
        return (*written, *[self.word(m) for m in _MIXED(core) if any(c.isalpha() for c in m) and (not m.isalpha() or _STRETCHED(m))])

    def text(self, text: str) -> str:
        """A text, lower-cased, with every suspicious token restored."""
        low = _SPACED.sub(lambda m: self.word(m.group()), text.lower())

        def clean(m):
            written, read = _WORDS(m.group()), self.token(m.group())
            return " ".join(read[len(written):]) if len(read) > len(written) else m.group()

        return re.sub(r"\S+", clean, low)

    def words(self, text: str | None) -> set[str]:
        """Distinct words of a text, as written and restored."""
        if not text:
            return set()
        low = text.lower()
        tokens = low.split()
        distinct, memo, found = set(tokens), self.memo, set()
        for t in distinct:
            found.update(memo.get(t) or self.token(t))
        if sum(len(t) == 1 for t in distinct) > 1:
            for m in _SPACED.finditer(low):
                found.update(self.word(m.group()).split())
        return found


@dataclass
class ToxicityModel:
    restorer: Restorer
    weights: dict[str, float]
    slope: float = 1.0
    base: float = 0.0

    def score(self, text: str | None) -> tuple[float, list[str]]:
        found = sorted(self.restorer.words(text) & self.weights.keys())
        x = self.slope * sum(self.weights[w] for w in found) + self.base
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x)))), found


def _sketch(text: str | None) -> list[int]:
    """Four min-hashes of a text's five-word shingles: near copies share most of them."""
    s = shingles(word_hashes(text), 5) if text else np.zeros(0, np.uint64)
    return [int(mix(s ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).min() >> np.uint64(1)) if len(s) else 0 for k in range(1, 5)]


def _curve(x: np.ndarray, y: np.ndarray, worth: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression of y on x by Newton steps with a weak prior (slope 1, base rate)."""
    w = np.array([1.0, math.log(((worth * y).sum() + 0.5) / ((worth * (1 - y)).sum() + 0.5))])
    prior, strength = w.copy(), np.array([1.0, 0.1])
    a = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        grad = a.T @ (worth * (y - p)) - strength * (w - prior)
        hess = (a * (worth * p * (1 - p))[:, None]).T @ a + np.diag(strength)
        step = np.linalg.solve(hess, grad)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(w[0])), float(w[1])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Fits the model on rows whose crc32 of the id modulo 3 is not 1."""
    texts = docs.where(fold("doc_id", 3) != 1).select("doc_id", "text")
    restorer = Restorer.of(trigram_counts(texts))
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(fold("doc_id", 3) != 1)
    n = marks.count()
    if n > rows:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < rows)
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # The marks are at most about ``rows`` pairs of numbers: a bounded side to broadcast.
    sample = texts.join(F.broadcast(marks), "doc_id").select("toxic", "text")

    def words(batches):
        for b in batches:
            seen = [Counter(), Counter()]
            for y, t in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist(), strict=True):
                seen[y].update(restorer.words(t))
                seen[y][""] += 1
            w = [*(seen[0] | seen[1])]
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), *[pa.array([s[x] for x in w], pa.int64()) for s in seen]], names=["word", "clean", "toxic"])

    counts = sample.mapInArrow(words, "word string, clean bigint, toxic bigint").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    total = {r.word: r for r in counts.where("word = ''").collect()}.get("")
    if total is None or not total.clean or not total.toxic:
        share = 0.5 if total is None else float(bool(total.toxic))
        return ToxicityModel(restorer, {}, 1.0, math.log((share + 1e-6) / (1 - share + 1e-6)))
    nt, nc = total.toxic, total.clean
    lift = (F.col("toxic") + 0.5) / (nt + 1.0) / ((F.col("clean") + 0.5) / (nc + 1.0))
    # Candidates: words a few times likelier in toxic rows, the best supported first.
    chosen = (counts.where(f"word <> '' AND toxic >= {MIN_TOXIC_ROWS}").where(lift >= 3)
              .orderBy((F.log(lift) * F.sqrt("toxic")).desc(), "word").limit(MAX_WORDS).collect())
    names = sorted(r.word for r in chosen)

    def hits(batches):
        place = {w: i for i, w in enumerate(names)}
        for b in batches:
            texts = b.column("text").to_pylist()
            got = [[place[w] for w in restorer.words(t) & place.keys()] for t in texts]
            keys = [_sketch(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(got, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64()))], names=["toxic", "hits", "keys"])

    data = sample.mapInArrow(hits, "toxic int, hits array<int>, keys array<bigint>").collect()     # about ``rows`` rows at most
    y = np.array([r.toxic for r in data], float)
    keys = np.array([r.keys for r in data], np.int64)
    # Copies and near copies of one text weigh together about as much as one text.
    sizes = [np.unique(k, return_inverse=True, return_counts=True) for k in keys.T]
    worth = 1 / np.max([n[i] for _, i, n in sizes], 0)
    row = np.repeat(np.arange(len(data)), [len(r.hits) for r in data])
    word = np.array([i for r in data for i in r.hits], np.int64)

    def lexicon(use: np.ndarray) -> np.ndarray:
        """Weight of each candidate by the rows in use; 0 if they don't bear it out."""
        v = worth * use
        all_t, all_c = (v * y).sum(), (v * (1 - y)).sum()
        t, c = np.bincount(word, (v * y)[row], len(names)), np.bincount(word, (v * (1 - y))[row], len(names))
        if not all_t or not all_c:
            return np.zeros(len(names))
        sure = (t >= LEAST_TEXTS) & ((t - np.sqrt(t)) / all_t >= LEAST_LIFT * (c + 0.5) / all_c)
        return np.where(sure, np.log((t + 0.5) / (all_t + 1)) - np.log((c + 0.5) / (all_c + 1)), 0)

    # The curve is fitted on evidence from weights that the other half of the texts gave.
    half = keys[:, 0] % 2 == 0
    x = np.zeros(len(data))
    for own in (half, ~half):
        w = lexicon(~own)
        x[own] = np.bincount(row, w[word], len(data))[own]
    slope, base = _curve(x, y, worth)
    final = lexicon(np.ones(len(data), bool))
    return ToxicityModel(restorer, {w: float(v) for w, v in zip(names, final.tolist(), strict=True) if v}, slope, base)


def score_column(text: Column, model: ToxicityModel) -> Column:
    """struct<score, words>: probability of label 1 and the words that speak for it."""
    kind = pa.struct([("score", pa.float64()), ("words", pa.list_(pa.string()))])

    @F.arrow_udf("score double, words array<string>")
    def f(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([dict(zip(("score", "words"), model.score(t.as_py()), strict=True)) for t in texts], kind)

    return f(text)


def restore_column(text: Column, model: ToxicityModel) -> Column:
    """Each text, lower-cased and deobfuscated (null stays null)."""

    @F.arrow_udf("string")
    def f(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([None if t.as_py() is None else model.restorer.text(t.as_py()) for t in texts], pa.string())

    return f(text)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, words of every row."""
    model = train(docs, labels)
    return (docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), score_column(F.col("text"), model).alias("r"))
            .select("doc_id", "held_out", "r.score", F.when(F.col("r.score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "r.words"))
