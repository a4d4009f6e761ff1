"""Operator 10 against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from vectorlint.llm import bpe

POOL = [" ", "  ", "\n", "\t", "\r\n", "\xa0", " ", "　", "\x85", "\x1c", "a", "the", "é", "'s", "'", "1", "٣", "$", "$$", "!", "<|endoftext|>",
        "漢", "\U0001f600", "​", "ñ", "E", "²", "ः", "́", "�"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.VOCABULARY)


def test_same_ids_and_text_as_the_library(library):
    own, rng = bpe.ForcedBoundaryBPE(), random.Random(5)
    texts = ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    for t, packed in zip(texts, own.encode_many(texts), strict=True):
        ids = np.frombuffer(packed, "<u4").tolist()
        assert ids == library.encode(t, add_special_tokens=False).ids, t
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False), t


def test_forced_pairs_occur_in_no_token():
    own = bpe.ForcedBoundaryBPE()
    assert own.forced.sum() > 30000
    for token in own.tokens[:-1]:
        assert not any(own.forced[a << 8 | b] for a, b in zip(token, token[1:]))


def test_small_dictionary_gives_the_same_ids(monkeypatch):
    texts = [f"word{i} other{i % 7}" for i in range(300)]
    full = list(bpe.ForcedBoundaryBPE().encode_many(texts))
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 5)
    monkeypatch.setattr(bpe, "RUN_CHARS", 20)
    assert list(bpe.ForcedBoundaryBPE().encode_many(texts)) == full


def test_query(spark, library):
    rows = [(1, "the cat\n\nsat", "x"), (2, None, "y"), (3, "", None), (None, "a", "z"), (1, "the cat\n\nsat", "x"), (5, "long word " * 30000, "q")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = bpe.round_trip_digests(docs).collect()
    assert len(got) == 6
    by = {r.doc_id: r for r in got}
    for i, t, _ in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4")
        assert by[i].n_tokens == len(ids)
        assert by[i].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert by[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip_digests(docs.limit(0)).count() == 0
    back = docs.select(bpe.decode_column(bpe.encode_column(docs.text)).alias("t")).collect()
    assert [r.t for r in back] == [t or "" for _, t, _ in rows]


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "aeiou", "e", "éü中", "a1 -"])
def test_long_runs_match_the_library(library, letters):
    """Pieces on both sides of the length from which a heap merges them, and very long ones."""
    own, rng = bpe.ForcedBoundaryBPE(), random.Random(5)
    for n in (bpe.LONG - 1, bpe.LONG, bpe.LONG + 1, 300, 20_000):
        text = "".join(rng.choice(letters) for _ in range(n))
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
        assert own.decode(own.encode(text)) == text
