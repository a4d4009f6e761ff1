"""Operator 4: benchmark decontamination by greedy string tiling.

1. Seeds: every run of ``SEED_WORDS`` normalised words of a benchmark item is a
   seed.  A document is a candidate for the items with which it shares one.
   The shared-seed join is an equi-join on the seed's hash; documents send to
   it only the seeds that pass a bit table of all benchmark seeds.  The table
   has a fixed size whatever the benchmark's (a larger benchmark only lets
   more documents pass to the exact join).
2. Tiles: for each candidate pair, running Karp-Rabin finds the longest
   matches between unmarked words, marks them, and goes on with shorter ones
   down to ``MIN_TILE`` words (greedy string tiling), so that a passage whose
   parts were reordered is still covered.
3. Verdict: a document leaks an item if tiles cover at least ``COVERAGE`` of
   the item's words.

Words are maximal runs of letters and digits, case-folded, so markup and
punctuation between words change nothing.

Defined results: null and empty texts and items match nothing; an item of
fewer than ``SEED_WORDS`` words is one seed as a whole; repeated rows and
repeated items are judged one by one (equal rows give equal results); empty
tables give no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorlint.llm.common import bit_table
from vectorlint.llm.words import mix, span_hashes
from vectorlint.session import materialize

SEED_WORDS = 5
MIN_TILE = 3
COVERAGE = 0.5
#: Bits of the seed table (2^24 bits are 2 MB).
TABLE_BITS = 24

_TOKENS = re.compile(r"[^\W_]+").findall
_NARROW = np.zeros(256, bool)
_NARROW[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def tokens(text: str | None) -> list[str]:
    return _TOKENS(text.casefold()) if text else []


def _token_hashes(text: str) -> np.ndarray:
    """Hash of every token of a text, without an object per token where the
    text is ASCII."""
    low = text.casefold()
    b = np.frombuffer(low.encode(), np.uint8)
    if low.isascii():
        solid = np.zeros(len(b) + 2, bool)
        solid[1:-1] = _NARROW[b]
    else:
        codes = np.frombuffer(low.encode("utf-32-le"), np.uint32)
        wide = _alnum()[np.minimum(codes, 0xFFFF)]
        for i in np.flatnonzero(codes > 0xFFFF).tolist():
            wide[i] = chr(codes[i]).isalnum()
        width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        solid = np.zeros(len(b) + 2, bool)
        solid[1:-1] = np.repeat(wide, width)
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    return span_hashes(b, edge[::2], edge[1::2])


_ALNUM: list[np.ndarray] = []


def _alnum() -> np.ndarray:
    if not _ALNUM:
        _ALNUM.append(np.array([bool(_TOKENS(chr(c))) if not 0xD800 <= c < 0xE000 else False for c in range(0x10000)]))
    return _ALNUM[0]


def _seeds(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of exactly ``n`` words."""
    if len(words) < n:
        return words[:0]
    h = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[j:len(words) - n + 1 + j])
    return h


def greedy_tiles(doc: list, item: list, min_tile: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Tiles (start in doc, start in item, length): greedy string tiling by
    running Karp-Rabin.  Each round takes the longest matches of unmarked
    words first, leftmost in the document, then in the item."""
    used_d, used_i = bytearray(len(doc)), bytearray(len(item))
    tiles, size = [], min(20, len(item))
    while size >= min_tile:
        # Karp-Rabin table of the item's unmarked runs of `size` words.
        table: dict[int, list[int]] = {}
        for i in range(len(item) - size + 1):
            if not any(used_i[i:i + size]):
                table.setdefault(hash(tuple(item[i:i + size])), []).append(i)
        found = []
        for d in range(len(doc) - size + 1) if table else ():
            for i in table.get(hash(tuple(doc[d:d + size])), ()):
                if any(used_d[d:d + size]):
                    break
                k = 0
                while d + k < len(doc) and i + k < len(item) and doc[d + k] == item[i + k] and not used_d[d + k] and not used_i[i + k]:
                    k += 1
                if k >= size:
                    found.append((-k, d, i))
        if found and -min(found)[0] > 2 * size:
            size = -min(found)[0]                # a far longer match: start from its length
            continue
        again = False
        for k, d, i in sorted(found):
            k = -k
            if any(used_d[d:d + k]) or any(used_i[i:i + k]):
                again = True                     # partly covered by a tile just marked
                continue
            used_d[d:d + k] = used_i[i:i + k] = b"\1" * k
            tiles.append((d, i, k))
        if again and any(not any(used_d[d:d + size]) and not any(used_i[i:i + size]) for _, d, i in found):
            continue
        size = max(min_tile, size // 2) if size > min_tile else 0
    return tiles


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Leaking pairs: doc_id, item_id, n_tokens (of the item), covered, tiles,
    coverage, spans (start and length in words of the document's tiles), and
    text_key, the hash of the document's text."""
    id_type, doc_type = dict(benchmark.dtypes)["item_id"], dict(docs.dtypes)["doc_id"]
    items = materialize(benchmark.select("item_id", F.col("text").alias("item"), F.monotonically_increasing_id().alias("item_row")), "benchmark")

    def item_seeds(batches):
        for b in batches:
            rows = []
            for i, t in zip(b.column("item_row").to_pylist(), b.column("item").to_pylist(), strict=True):
                w = _token_hashes(t) if t else np.zeros(0, np.uint64)
                if len(w):
                    n = min(SEED_WORDS, len(w))
                    rows += [(h, n, i) for h in set(_seeds(w, n).view(np.int64).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64()))], names=["seed", "n", "item_row"])

    seeds = materialize(items.select("item_row", "item").mapInArrow(item_seeds, "seed bigint, n int, item_row bigint"), "benchmark-seeds")
    lengths = sorted(r[0] for r in seeds.select("n").distinct().collect())
    table = bit_table(seeds, "seed", TABLE_BITS)

    def candidates(batches):
        hit = table.value
        for b in batches:
            keys, texts, found = [], [], []
            column = b.column("text")
            for row in range(b.num_rows):
                t = column[row].as_py()
                if not t:
                    continue
                w = _token_hashes(t)
                own = []
                for n in lengths:
                    h = _seeds(w, n)
                    h = h[hit[h >> np.uint64(64 - TABLE_BITS)]]
                    own += set(h.view(np.int64).tolist())
                if own:
                    keys.append(row)
                    texts.append(t)
                    found.append(own)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(keys, pa.int32())), pa.array(texts, pa.string()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "text", "seeds"])

    passed = docs.select("doc_id", "text").mapInArrow(candidates, f"doc_id {doc_type}, text string, seeds array<bigint>")
    passed = materialize(passed.withColumn("row", F.monotonically_increasing_id()), "leak-candidates")
    shared = passed.select("row", F.explode("seeds").alias("seed")).join(seeds.select("seed", "item_row"), "seed").select("row", "item_row").distinct()
    pairs = shared.join(passed.select("row", "doc_id", "text"), "row").join(items, "item_row")

    def tile(batches):
        for b in batches:
            out = []
            for row, i, d, item, text in zip(*[b.column(c).to_pylist() for c in ("row", "item_id", "doc_id", "item", "text")], strict=True):
                target = tokens(item)
                tiles = greedy_tiles(tokens(text), target)
                covered = sum(k for _, _, k in tiles)
                if not tiles and len(target) < MIN_TILE:
                    covered = len(target)        # a shorter item is matched by its whole seed
                if covered >= coverage * len(target):
                    out.append((d, i, len(target), covered, len(tiles), covered / len(target), [{"start": a, "length": k} for a, _, k in sorted(tiles)], row))
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (b.column("doc_id").type, b.column("item_id").type, pa.int64(), pa.int64(), pa.int64(), pa.float64(), spans, pa.int64()), strict=True)], names=names)

    names = ["doc_id", "item_id", "n_tokens", "covered", "tiles", "coverage", "spans", "row"]
    spans = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
    found = pairs.select("row", "item_id", "doc_id", "item", "text").mapInArrow(tile, f"doc_id {doc_type}, item_id {id_type}, n_tokens bigint, covered bigint, tiles bigint, coverage double, spans array<struct<start:int,length:int>>, row bigint")
    return found.join(passed.select("row", F.xxhash64("text").alias("text_key")), "row").drop("row")


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id and the tiling of every leak."""
    return leaks(docs, benchmark).drop("text_key")
