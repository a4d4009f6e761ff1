"""Operator 10: BPE encoding and decoding by forced-boundary splitting.

A merge can only join two bytes that stand next to each other inside some
vocabulary token.  Byte pairs that occur inside *no* token are therefore
certain cuts: whatever lies left and right of them is encoded independently,
and the id lists are concatenated.

Two levels of cuts are used:

1. over a whole text, vectorised: forced pairs (x, white space) with x not
   white space.  The pre-tokenizer also always ends a piece there, so the
   fragments (in practice a word with the blanks before it) can be handled
   one by one, and a fragment seen before is a dictionary hit;
2. inside a fragment's pre-tokens: every forced pair cuts again, and the
   remaining pieces go through the merge loop in rank order: pieces of one
   length together, pieces over ``LONG`` bytes one by one with a heap.

Defined results: a null text counts as empty; an empty text has 0 tokens and
the digests of the empty string; equal texts have equal ids; the special
token's own string is its single id, as in the tokenizers library.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Entries of the fragment dictionary of one Python worker, and characters that
#: are cut into fragments at a time (a longer text is taken whole).
CACHE_ENTRIES = 500_000
RUN_CHARS = 1_500_000
#: Pieces up to this many bytes are merged side by side in rounds; a round looks
#: at whole pieces, so longer ones take a heap (n log n).
LONG = 64

# Unicode white space, and the pre-tokenizer's pattern over it.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
if sys.byteorder != "little":
    raise ImportError("ids are packed in the machine's byte order, which must be little-endian")
_ASCII_WS = b"\t\n\x0b\x0c\r "
_WIDE_WS = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_WS2 = np.array([int.from_bytes(b, "big") for b in _WIDE_WS if len(b) == 2], np.uint32)
_WS3 = np.array([int.from_bytes(b, "big") for b in _WIDE_WS if len(b) == 3], np.uint32)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryBPE:
    """Byte-level BPE of one vocabulary file."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            if token not in self.special:
                self.tokens[i] = bytes(letters[c] for c in token)
        inside = np.zeros(65536, bool)
        for token in self.tokens:
            for pair in zip(token, token[1:], strict=False):
                inside[pair[0] << 8 | pair[1]] = True
        #: Byte pairs, as one 16-bit number, that occur inside no token.
        self.forced = ~inside
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        pair = np.arange(65536)
        blank = np.isin(np.arange(256), list(_ASCII_WS))
        self._outer = self.forced & blank[pair & 255] & ~blank[pair >> 8]
        self._byte_id = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        self._rank = np.argsort(keys)           # rank of each merge, by sorted key
        self._keys = keys[self._rank]
        self._made = np.array([vocab[a + b] for a, b in merges], np.int32)
        left, right = self._byte_id[pair >> 8], self._byte_id[pair & 255]
        self._byte_ranks = self._ranks(left, right).astype(np.int32)   # of each pair of single bytes
        self._merge_of: dict[int, int] = {}     # key -> rank, filled for the first long piece
        self._split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._pretokens = regex.compile(_PRETOKEN).findall
        self._known: dict[bytes, bytes] = {}    # fragment -> packed ids

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of ids (len(merges) where there is none)."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._rank[at], len(self._keys))

    def _merge_rows(self, pieces: np.ndarray) -> np.ndarray:
        """The merge loop for pieces of one length, a row of bytes each: in every
        round each piece takes its lowest-ranked merge, leftmost among equals.
        A row of ids each, filled up with -1."""
        n, never = pieces.shape[1], len(self._keys)
        out = np.full(pieces.shape, -1, np.int32)
        ids = self._byte_id[pieces]
        ranks = np.full((len(ids), n + 1), never, np.int32)    # two more columns: no merge
        ranks[:, :n - 1] = self._byte_ranks[pieces[:, :-1].astype(np.uint16) << 8 | pieces[:, 1:]]
        rows = np.arange(len(ids))              # pieces still in work
        for size in range(n, 0, -1):
            best = ranks.argmin(1)
            rank = ranks[np.arange(len(ids)), best]
            go = rank < never
            if not go.all():
                out[rows[~go], :size] = ids[~go]
                ids, ranks, rows, best, rank = ids[go], ranks[go], rows[go], best[go], rank[go]
            if not len(rows):
                break
            line, place = np.arange(len(ids)), np.arange(size + 1)
            new = ids[line, best] = self._made[rank]
            ids = ids[place[:size] != best[:, None] + 1].reshape(-1, size - 1)
            ranks = ranks[place != best[:, None]].reshape(-1, size)
            left = np.maximum(best - 1, 0)
            ranks[line, left] = np.where(best > 0, self._ranks(ids[line, left], new), ranks[line, left])
            right = np.minimum(best + 1, size - 2)
            ranks[line, best] = np.where(best < size - 2, self._ranks(new, ids[line, right]), never)
        return out

    def _merge_long(self, piece: np.ndarray) -> list[int]:
        """The same merges for one long piece: neighbours as a linked list, pairs
        in a heap by rank and place; pairs that are no longer there are passed over."""
        if not self._merge_of:
            self._merge_of = dict(zip(self._keys.tolist(), self._rank.tolist(), strict=True))
        rank_of, made, n = self._merge_of, self._made.tolist(), len(piece)
        ids = self._byte_id[piece].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self._byte_ranks[piece[:-1].astype(np.uint16) << 8 | piece[1:]]
        at = np.flatnonzero(ranks < len(self._keys))
        heap = list(zip(ranks[at].tolist(), at.tolist(), [ids[i] << 32 | ids[i + 1] for i in at.tolist()], strict=True))
        heapq.heapify(heap)
        while heap:
            rank, i, key = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] << 32 | ids[j] != key:
                continue
            ids[i], ids[j] = made[rank], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                key = ids[i] << 32 | ids[k]
                if key in rank_of:
                    heapq.heappush(heap, (rank_of[key], i, key))
            h = before[i]
            if h >= 0:
                key = ids[h] << 32 | ids[i]
                if key in rank_of:
                    heapq.heappush(heap, (rank_of[key], h, key))
        return [x for x in ids if x >= 0]

    def _learn(self, fragments: list[bytes]) -> None:
        """Encodes fragments that are not known yet."""
        sizes = []                              # of their pre-tokens, in bytes
        for f in fragments:
            if f[:1] == b" " and f[1:].isalpha():
                sizes.append(len(f))            # a blank and ASCII letters are one pre-token
            elif f.isascii():
                sizes.extend(map(len, self._pretokens(f.decode())))
            else:
                sizes.extend(len(t.encode()) for t in self._pretokens(f.decode()))
        a = np.frombuffer(b"".join(fragments), np.uint8)
        begins = np.zeros(len(a), bool)
        begins[1:] = self.forced[a[:-1].astype(np.uint16) << 8 | a[1:]]
        begins[np.cumsum([0, *sizes[:-1]])] = True
        starts = np.flatnonzero(begins)
        lengths = np.diff(starts, append=len(a))
        ids = np.full(len(a), -1, np.int32)     # a piece's ids stand from its start on
        single = starts[lengths == 1]
        ids[single] = self._byte_id[a[single]]
        order = np.argsort(lengths, kind="stable")
        kinds, first = np.unique(lengths[order], return_index=True)
        for n, same in zip(kinds.tolist(), np.split(starts[order], first[1:]), strict=True):
            if n > LONG:
                for i in same.tolist():
                    got = self._merge_long(a[i:i + n])
                    ids[i:i + len(got)] = got
            elif n > 1:
                step = 400_000 // n
                for i in range(0, len(same), step):
                    at = same[i:i + step, None] + np.arange(n)
                    ids[at] = self._merge_rows(a[at])
        used = ids >= 0
        packed = ids[used].tobytes()
        ends = (4 * np.cumsum(used)[np.cumsum(list(map(len, fragments))) - 1]).tolist()
        self._known.update(zip(fragments, map(packed.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))

    def _cuts(self, b: bytes) -> list[int]:
        """Outer cuts of a text: forced pairs whose right byte is a blank and
        whose left one ends no white space."""
        a = np.frombuffer(b, np.uint8)
        at = np.flatnonzero(self._outer[a[:-1].astype(np.uint16) << 8 | a[1:]]) + 1
        if not b.isascii():
            wide = np.flatnonzero(a[at - 1] >= 0x80)
            p = at[wide]
            p, wide = p[p >= 2], wide[p >= 2]
            two = a[p - 2].astype(np.uint32) << 8 | a[p - 1]
            three = np.where(p >= 3, a[np.maximum(p, 3) - 3], 0).astype(np.uint32) << 16 | two
            at = np.delete(at, wide[np.isin(two, _WS2) | np.isin(three, _WS3)])
        return at.tolist()

    def _fragments(self, text: str) -> list[bytes]:
        b = text.encode()
        if len(b) < 2:
            return [b] if b else []
        at = self._cuts(b)
        return list(map(b.__getitem__, map(slice, [0, *at], [*at, len(b)])))

    def _encode_some(self, texts: list[str]) -> list[bytes]:
        parts = [[t] if self._split_special is None or not any(s in t for s in self.special) else self._split_special.split(t) for t in texts]
        cut = [[None if x in self.special else self._fragments(x) for x in own] for own in parts]
        known = self._known
        missing = {f for own in cut for x in own if x for f in x if f not in known}
        if len(known) + len(missing) > CACHE_ENTRIES:           # the dictionary starts afresh
            known.clear()
            missing = {f for own in cut for x in own if x for f in x}
        if missing:
            self._learn(list(missing))
        get = self._known.__getitem__
        return [b"".join(array("I", [self.special[p]]).tobytes() if x is None else b"".join(map(get, x))
                         for p, x in zip(own, frags, strict=True)) for own, frags in zip(parts, cut, strict=True)]

    def encode_many(self, texts) -> Iterator[bytes]:
        """Packed ids (little-endian unsigned 32-bit) of each text, worked off
        in runs of about ``RUN_CHARS`` characters."""
        run, chars = [], 0
        for t in texts:
            run.append(t)
            chars += len(t)
            if chars >= RUN_CHARS:
                yield from self._encode_some(run)
                run, chars = [], 0
        yield from self._encode_some(run)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(next(self.encode_many([text])), "<u4").tolist()

    def decode(self, ids) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


def _over_texts(vocabulary: str, row, kind: pa.DataType, returns: str):
    """A column function: ``row(bpe, packed ids)`` of every text."""

    @F.arrow_udf(returns)
    def f(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = ForcedBoundaryBPE(vocabulary)
        for texts in batches:
            yield pa.array([row(bpe, ids) for ids in bpe.encode_many(t.as_py() or "" for t in texts)], kind)

    return f


def encode_column(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """array<int> ids of each text."""
    return _over_texts(vocabulary, lambda _, ids: np.frombuffer(ids, "<i4"), pa.list_(pa.int32()), "array<int>")(text)


def decode_column(ids: Column, vocabulary: str = VOCABULARY) -> Column:
    """The text of each array<int> of ids (null: empty)."""

    @F.arrow_udf("string")
    def f(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = ForcedBoundaryBPE(vocabulary)
        for rows in batches:
            yield pa.array([bpe.decode(r.as_py() or ()) for r in rows], pa.string())

    return f(ids)


_DIGESTS = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _digests(bpe: ForcedBoundaryBPE, ids: bytes) -> dict:
    back = bpe.decode(np.frombuffer(ids, "<u4").tolist())
    return {"n_tokens": len(ids) // 4, "ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": hashlib.sha256(back.encode()).hexdigest()}


def round_trip_digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row's whole text.

    Each row is judged by itself (no shuffle): repeated rows give repeated
    results, null doc_ids stay null."""
    f = _over_texts(vocabulary, _digests, _DIGESTS, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return docs.select("doc_id", f("text").alias("r")).select("doc_id", "r.*")
