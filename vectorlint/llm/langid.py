"""Operator 5: language identification with hyperdimensional profiles.

Every letter (and the gap between words) owns a random +-1 vector.  An n-gram
of letters is bound into one vector, the product of its letters' vectors, each
permuted (rotated) by its place; a text is the bundle (sum) of its n-gram
vectors; a language's prototype is the bundle of its training texts, each
scaled to unit length.  A text gets the language whose prototype has the
largest cosine with it.

Text vectors are computed where the text lies (an Arrow column function); the
prototypes are integer sums with map-side combine, so the only thing shuffled
is one small vector per task and language, and the result does not depend on
the order of the sums.

Defined results: a null text, or one without a letter, is ``und`` with score
0; ties go to the alphabetically first language; without any training text
everything is ``und``; repeated rows are judged (and counted) one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorlint.llm.common import fold

#: Dimensions, n-gram lengths, and the seed of the letters' random vectors.
DIMENSIONS = 512
NGRAMS = (2, 3)
SEED = 20260301
#: Languages that may be learned; beyond it the prototypes are no longer a
#: small side table and training raises.
MAX_LANGUAGES = 2000
#: Characters of texts whose n-grams are bound at a time.
RUN_CHARS = 400_000
#: Alphabets up to this size index their n-grams by table, larger ones by sorting.
MANY_LETTERS = 200
#: Training rows learned from per language (chosen by a hash of the id); a
#: language with fewer rows is learned from whole.
TRAIN_ROWS = 10_000
UNKNOWN = "und"
_SCALE = 1 << 24
_BLOCK = 64


@lru_cache(100_000)
def _letter(code: int) -> np.ndarray:
    return np.random.default_rng((SEED, code)).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1


@lru_cache(1)
def _letter_table() -> np.ndarray:
    """Lower-case letter of each code point of the basic plane, 0 if it is none."""
    out = np.zeros(0x10000, np.int64)
    for c in range(0x10000):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low[0])
    return out


def _symbols(text: str) -> np.ndarray:
    """Letters of a text as code points; every run of other characters is one
    gap (0), also before the first and after the last letter."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    low = _letter_table()[np.minimum(codes, 0xFFFF)]
    for i in np.flatnonzero(codes > 0xFFFF).tolist():
        c = chr(codes[i])
        low[i] = ord(c.lower()[0]) if c.isalpha() else 0
    low = np.concatenate([[0], low, [0]])
    keep = low > 0
    keep[1:] |= low[:-1] > 0
    keep[0] = True
    return low[keep] if len(codes) and low.any() else low[:0]


def _ngrams(symbols: np.ndarray, size: int) -> np.ndarray:
    """Keys of all n-grams of symbols below ``size``; each length has its own range."""
    out = []
    for n in NGRAMS:
        if len(symbols) >= n:
            key = np.full(len(symbols) - n + 1, sum(size ** k for k in range(1, n)), np.int64)
            for j in range(n):
                key += symbols[j:len(symbols) - n + 1 + j] * size ** (n - 1 - j)
            out.append(key)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _bind(keys: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The vectors of distinct n-gram keys over the given letters."""
    out = np.ones((len(keys), DIMENSIONS), np.float32)
    size = len(letters)
    for n in NGRAMS:
        first = sum(size ** k for k in range(1, n))
        own = np.flatnonzero((keys >= first) & (keys < first + size ** n))
        for place in range(n):
            rolled = np.array([np.roll(_letter(c), n - 1 - place) for c in letters.tolist()], np.float32)
            out[own] *= rolled[(keys[own] - first) // size ** (n - 1 - place) % size]
    return out


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with inverse for small keys, by table instead of by sorting."""
    seen = np.zeros(int(keys.max(initial=-1)) + 1, bool)
    seen[keys] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[keys]


def _vectors(texts: list[str | None]) -> Iterator[np.ndarray | None]:
    """Unit vector of each text (None without a letter)."""
    run: list[np.ndarray] = []
    chars = 0

    def work():
        letters = np.unique(np.concatenate(run))
        if not len(letters):
            yield from [None] * len(run)
            return
        keys = [_ngrams(np.searchsorted(letters, x), len(letters)) for x in run]
        used, where = np.unique(np.concatenate(keys), return_inverse=True) if len(letters) > MANY_LETTERS else _dense(np.concatenate(keys))
        bound, start = _bind(used, letters), 0
        for k in keys:
            if not len(k):
                yield None
                continue
            counts = np.bincount(where[start:start + len(k)])
            start += len(k)
            own = np.flatnonzero(counts)
            v = counts[own].astype(np.float32) @ bound[own]
            size = float(np.sqrt(np.dot(v, v)))
            yield v / size if size else None

    for t in texts:
        run.append(_symbols(t or ""))
        chars += len(t or "")
        if chars >= RUN_CHARS:
            yield from work()
            run, chars = [], 0
    if run:
        yield from work()


def prototypes(train: DataFrame) -> dict[str, np.ndarray]:
    """Unit prototype of each language of (text, lang) rows with a language.

    One row per task, language and block of dimensions is shuffled; the
    driver gets one vector per language (at most ``MAX_LANGUAGES``)."""

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, v in zip(b.column("lang").to_pylist(), _vectors(b.column("text").to_pylist()), strict=True):
                if v is not None:
                    sums.setdefault(lang, np.zeros(DIMENSIONS, np.int64))
                    sums[lang] += np.rint(v * _SCALE).astype(np.int64)
        rows = [(lang, i // _BLOCK, *v[i:i + _BLOCK].tolist()) for lang, v in sums.items() for i in range(0, DIMENSIONS, _BLOCK)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    values = [f"v{i}" for i in range(_BLOCK)]
    names, kinds = ["lang", "block", *values], [pa.string(), pa.int32(), *[pa.int64()] * _BLOCK]
    parts = (train.select("lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
             .mapInArrow(bundle, ", ".join(["lang string", "block int", *[f"{v} bigint" for v in values]])))
    summed = parts.groupBy("lang", "block").agg(*[F.sum(v).cast("double").alias(v) for v in values])
    rows = summed.limit(MAX_LANGUAGES * DIMENSIONS // _BLOCK + 1).collect()
    if len(rows) > MAX_LANGUAGES * DIMENSIONS // _BLOCK:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found: dict[str, np.ndarray] = {}
    for r in rows:
        found.setdefault(r[0], np.zeros(DIMENSIONS))[r[1] * _BLOCK:(r[1] + 1) * _BLOCK] = r[2:]
    return {k: v / (np.linalg.norm(v) or 1) for k, v in sorted(found.items())}


def identify(text: Column, learned: dict[str, np.ndarray]) -> Column:
    """struct<lang_pred, score, margin> of each text; margin is the lead over the second language."""
    names, table = list(learned), np.array(list(learned.values()), np.float32).reshape(-1, DIMENSIONS)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64())])

    @F.arrow_udf("lang_pred string, score double, margin double")
    def f(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for v in _vectors(texts.to_pylist()):
                if v is None or not names:
                    out.append((UNKNOWN, 0.0, 0.0))
                    continue
                cosine = table @ v
                best = int(cosine.argmax())
                rest = np.delete(cosine, best)
                score = min(1.0, max(0.0, float(cosine[best])))
                out.append((names[best], score, score - max(0.0, float(rest.max())) if len(rest) else score))
            yield pa.array([dict(zip(("lang_pred", "score", "margin"), x, strict=True)) for x in out], kind)

    return f(text)


def training_rows(docs: DataFrame, per_language: int = TRAIN_ROWS) -> DataFrame:
    """(text, lang) of rows that may be learned from (crc32 of the id modulo 4
    is not 2), about ``per_language`` of each language, by a hash of the id."""
    rows = docs.where(fold("doc_id", 4) != 2).where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    sizes = rows.groupBy("lang").count().where(F.col("count") > per_language).limit(MAX_LANGUAGES).collect()
    large = {r[0]: r[1] for r in sizes}
    if large:
        n = F.coalesce(F.create_map(*[F.lit(x) for kv in large.items() for x in kv])[F.col("lang")], F.lit(per_language))
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), n) < per_language)
    return rows.select("text", "lang")


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin of every row."""
    learned = prototypes(training_rows(docs))
    return (docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), identify(F.col("text"), learned).alias("r"))
            .select("doc_id", "held_out", "r.*"))
