"""Operator 12: SimHash near-duplicates by a self-join of a binary trie.

A text's fingerprint has a bit set if it is set in over half of the XXH64 (seed
42) of its 4-word shingles, repeats included; fingerprints link at up to
``BUDGET`` = 4 differing bits.

1. Classes.  Equal fingerprints are one class; from here on a class is one node.
2. Tries.  The fingerprints are laid out in ``TURNS`` = 16 tries, one for each
   rotation by 4 bits.  Of the rotations of two fingerprints within the budget
   at least one spreads the differences evenly: after every 4 * k bits at most
   k * BUDGET / 16 of them lie behind (the cycle lemma).  So each trie is joined
   with itself under the error budget ``allowed(depth)``: none in the first 12
   bits, 1 up to bit 28, and so on, and no link is lost.
3. Self-join.  Pairs of trie nodes go down together, 4 bits at a time, and
   carry the bits that differ so far; a pair beyond its depth's budget is pruned
   with all below it.  A pair with at most ``LEAVES`` fingerprints is finished
   in one task; larger ones, however hot, go down further.
4. A finished pair of nodes gives the links that join its fingerprints' groups
   (never all pairs of a group); ``components`` does the rest.

Defined results: no words, empty or null text: fingerprint zero, linked like any
other; fewer words than a shingle: the whole sequence is the one shingle; a null
doc_id can't name a component: its component_id is the smallest id of its
component, or null; rows that repeat a doc_id are judged by their own text;
without rows no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorlint.llm.common import join_classes
from vectorlint.llm.components import components
from vectorlint.llm.words import _BLANK, _LOWER, word_spans
from vectorlint.session import materialize

SHINGLE = 4
BITS = 64
BUDGET = 4
#: Bits that a trie is descended by at a time, and rotations.
STEP = 4
TURNS = BITS // STEP
#: Most fingerprints of a pair of nodes that is finished in one task.
LEAVES = 1024
SEED = 42

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))    # fixed values of XXH64


def allowed(depth: int) -> int:
    """Most differing bits that the first ``depth`` bits of a rotation may hold."""
    return depth // STEP * BUDGET // TURNS


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(b: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of the spans (start, size) of the bytes ``b``, all at once: longer
    spans first, so that those with another stripe, lane or byte are a prefix."""
    order = np.argsort(-size, kind="stable")
    at, left = start[order].astype(np.int64), size[order].astype(np.int64)
    padded = np.concatenate([b, np.zeros(8, np.uint8)])
    lanes = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (len(b) + 1, 8), (1, 1))).view("<u8").ravel()
    with np.errstate(over="ignore"):
        s = np.uint64(seed)
        h = np.full(len(at), s + _P5, np.uint64)
        long = int(np.count_nonzero(left >= 32))
        if long:
            acc = [np.full(long, v, np.uint64) for v in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            n = long
            while n:
                for k in range(4):
                    acc[k][:n] = _round(acc[k][:n], lanes[at[:n] + 8 * k])
                at[:n] += 32
                left[:n] -= 32
                n = int(np.count_nonzero(left[:n] >= 32))
            g = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for a in acc:
                g = (g ^ _round(np.zeros_like(a), a)) * _P1 + _P4
            h[:long] = g
        h += size[order].astype(np.uint64)
        for _ in range(3):
            i = np.flatnonzero(left >= 8)
            h[i] = _rotl(h[i] ^ _round(np.zeros(len(i), np.uint64), lanes[at[i]]), 27) * _P1 + _P4
            at[i] += 8
            left[i] -= 8
        i = np.flatnonzero(left >= 4)
        h[i] = _rotl(h[i] ^ (lanes[at[i]] & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
        at[i] += 4
        left[i] -= 4
        for _ in range(3):
            i = np.flatnonzero(left > 0)
            h[i] = _rotl(h[i] ^ padded[at[i]].astype(np.uint64) * _P5, 11) * _P1
            at[i] += 1
            left[i] -= 1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        h ^= h >> np.uint64(32)
    out = np.empty_like(h)
    out[order] = h
    return out


#: Bytes of text, and hashes whose bits are counted, at a time.
CHUNK = 1 << 20


def _joined(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A text's words, A-Z lower-cased and joined by one blank, and their spans."""
    b = _LOWER[np.frombuffer(text.encode(), np.uint8)]
    start, end = word_spans(b)
    if not len(start):
        return b[:0], start, end
    solid = ~_BLANK[b]
    solid[end[:-1]] = True                  # one blank after each word but the last
    kept = np.cumsum(solid)
    b = np.where(_BLANK[b], np.uint8(32), b)[solid]
    return b, kept[start] - 1, kept[end - 1]


def _bit_counts(h: np.ndarray, texts: np.ndarray, n: int) -> np.ndarray:
    """How often each bit (lowest first) is set among the hashes of each of ``n`` texts; ``texts`` ascends."""
    out = np.zeros((n, BITS), np.int64)
    if len(h):
        first = np.flatnonzero(np.r_[True, texts[1:] != texts[:-1]])
        # Blocks of hashes are summed as bytes of 8 counts, 255 hashes at most at a time.
        cut = np.unique(np.concatenate([first, np.arange(0, len(h), 255)]))
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        part = np.add.reduceat(bits, cut, axis=0, dtype=np.uint8)
        own = texts[cut]
        new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        out[own[new]] = np.add.reduceat(part, new, axis=0, dtype=np.int64)
    return out


def fingerprints_of(texts: list[str | None], n: int = SHINGLE) -> np.ndarray:
    """Fingerprint (uint64) of each whole text."""
    out = np.zeros(len(texts), np.uint64)
    bytes_, starts, sizes, owners, counts, filled = [], [], [], [], np.zeros((len(texts), BITS), np.int64), 0
    total = np.zeros(len(texts), np.int64)

    def flush():
        nonlocal filled
        if starts:
            start, owner = np.concatenate(starts), np.concatenate(owners)
            h = xxh64(np.concatenate(bytes_), start, np.concatenate(sizes))
            own, at = np.unique(owner, return_inverse=True)
            counts[own] += _bit_counts(h, at, len(own))
        for x in (bytes_, starts, sizes, owners):
            x.clear()
        filled = 0

    for i, text in enumerate(texts):
        b, s, e = _joined(text) if text else (None, (), ())
        if not len(s):
            continue
        k = min(n, len(s))
        first, last = s[:len(s) - k + 1], e[k - 1:]
        total[i] = len(first)
        for lo in range(0, len(first), CHUNK // 8):         # a very long text in pieces
            f, l = first[lo:lo + CHUNK // 8], last[lo:lo + CHUNK // 8]
            bytes_.append(b[f[0]:l[-1]])
            starts.append(f - f[0] + filled)
            sizes.append(l - f)
            owners.append(np.full(len(f), i))
            filled += int(l[-1] - f[0])
            if filled >= CHUNK:
                flush()
    flush()
    bits = 2 * counts > total[:, None]
    out[:] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _signed(docs: DataFrame, n: int) -> DataFrame:
    def work(batches):
        for b in batches:
            fp = fingerprints_of(b.column("text").to_pylist(), n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {dict(docs.dtypes)['doc_id']}, fp bigint")


def _turned(fp: str, turn: str) -> str:
    """The fingerprint rotated left by ``turn`` * STEP bits."""
    return f"(shiftleft({fp}, {turn} * {STEP}) | shiftrightunsigned({fp}, {BITS} - {turn} * {STEP}))"


def _prefix(key: str, depth: int) -> str:
    return f"shiftrightunsigned({key}, {BITS - depth})" if depth < BITS else key


def _pair_links(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Links that join groups of fingerprints below one pair of nodes."""
    side, fp = table.column("side").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
    same = not (side == 1).any()
    u, v = (fp, fp) if same else (fp[side == 0], fp[side == 1])
    found = []
    for lo in range(0, len(u), 256):
        i, j = np.nonzero(np.bitwise_count(u[lo:lo + 256, None] ^ v[None]) <= BUDGET)
        i += lo
        keep = i < j if same else slice(None)
        found.append(np.stack([u[i[keep]], v[j[keep]]], 1))
    links = np.concatenate(found)
    nodes, at = np.unique(links, return_inverse=True)
    parent = np.arange(len(nodes))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for k, (a, b) in enumerate(at.reshape(-1, 2).tolist()):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append(k)
    links = links[out].view(np.int64)
    return pa.table({"a": pa.array(links[:, 0]), "b": pa.array(links[:, 1])})


def links(classes: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp: bigint) that join all of them
    that are within the budget."""
    leaves = classes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(TURNS - 1))).alias("turn")).withColumn("key", F.expr(_turned("fp", "turn")))
    depth = STEP * next(k for k in range(TURNS) if allowed(STEP * (k + 1)))      # no error so far: every node meets itself
    nodes = leaves.groupBy("turn", F.expr(_prefix("key", depth)).alias("u")).agg(F.count("*").alias("nu")).where("nu > 1")
    open_ = nodes.select("turn", "u", F.col("u").alias("v"), F.lit(0).alias("bits"), "nu", F.col("nu").alias("nv"))
    found = None
    while True:
        frontier = materialize(open_, "trie")
        size = "if(u = v, nu, nu + nv)"
        done = frontier.where(f"{size} <= {LEAVES}") if depth < BITS else frontier
        x = _finished(done.select("turn", "u", "v"), leaves, depth)
        found = x if found is None else found.unionByName(x)
        left = frontier.where(f"{size} > {LEAVES}")
        if depth >= BITS or left.isEmpty():
            return found
        # Children of the nodes that are still open.
        ends = left.select("turn", F.explode(F.array("u", "v")).alias("p")).distinct()
        below = depth + STEP
        child = (leaves.withColumn("p", F.expr(_prefix("key", depth))).join(ends, ["turn", "p"], "left_semi")
                 .groupBy("turn", "p", F.expr(_prefix("key", below)).alias("c")).agg(F.count("*").alias("n")))
        child = materialize(child.groupBy("turn", "p").agg(F.collect_list(F.struct("c", "n")).alias("below")), "trie-nodes")      # at most 2 ** STEP
        pairs = left.join(child.toDF("turn", "u", "cu"), ["turn", "u"]).join(child.toDF("turn", "v", "cv"), ["turn", "v"])
        pairs = pairs.select("turn", "bits", (F.col("u") == F.col("v")).alias("same"), F.explode("cu").alias("x"), "cv").select("*", F.explode("cv").alias("y"))
        pairs = pairs.where("NOT same OR x.c <= y.c").withColumn("bits", F.expr(f"bits + bit_count((x.c ^ y.c) & {2 ** STEP - 1})"))
        open_ = (pairs.where(f"bits <= {allowed(below)}").where("x.c <> y.c OR x.n > 1")
                 .select("turn", F.col("x.c").alias("u"), F.col("y.c").alias("v"), "bits", F.col("x.n").alias("nu"), F.col("y.n").alias("nv")))
        depth = below


def _finished(pairs: DataFrame, leaves: DataFrame, depth: int) -> DataFrame:
    """Links below finished pairs of nodes (turn, u, v) of a depth."""
    ends = pairs.select("turn", "u", "v", F.explode(F.expr("if(u = v, array(named_struct('side', 0, 'p', u)), array(named_struct('side', 0, 'p', u), named_struct('side', 1, 'p', v)))")).alias("e"))
    ends = ends.select("turn", "u", "v", "e.side", "e.p")
    met = leaves.withColumn("p", F.expr(_prefix("key", depth))).join(ends, ["turn", "p"]).select("turn", "u", "v", "side", "fp")
    return met.groupBy("turn", "u", "v").applyInArrow(_pair_links, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id of every row."""
    signed = materialize(_signed(docs, shingle), "simhash")
    doc_type = dict(docs.dtypes)["doc_id"]
    classes = materialize(signed.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "simhash-classes")
    labels = components(links(classes))
    grouped = classes.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = grouped.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of = materialize(grouped.join(least, "label").select("fp", "copies", F.col("component_id").cast(doc_type).alias("component_id")), "simhash-components")
    return join_classes(signed, of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
