"""Operator 8: near-duplicates by an inverted join of signature coordinates.

A text is its set of distinct ``SHINGLE``-word shingles; two texts are linked
if 100 * |A & B| >= 80 * |A | B|.

1. Signatures.  Every text gets ``COORDINATES`` min-hash coordinates.  Texts
   with equal sets form one class; from here on one node stands for a class.
2. Posting.  A node is posted under its (coordinate, value) pairs.  Two nodes
   that agree in at least ``MATCHES`` coordinates share a pair among the
   ``COORDINATES - MATCHES + 1`` rarest of either (prefix); pairs that only one
   node has drop out at once.  The common (long) lists are skipped: they are
   only probed, by comparing whole signatures of pairs found in short lists.
3. Merging.  Lists of up to ``SHORT`` nodes give all their pairs.  A longer
   list gives a star around its smallest node.  Pairs that agree in at least
   ``MATCHES`` coordinates are confirmed on the full sets.
4. Long lists whose nodes are not yet in one component are finished exactly:
   nodes outside the largest component of their family of lists are compared
   with the family's other components, in blocks of bounded size, on full
   sets; only links that join components leave a block.  Nothing is capped,
   and nodes already joined are never paired again.

Two texts at similarity 0.8 agree in fewer than ``MATCHES`` of the
``COORDINATES`` with a probability of about 1e-6.

Defined results: no words: empty set, own component, kept; fewer words than a
shingle: the whole sequence is the one shingle; a null doc_id can't name a
component: its component_id is the smallest id of its component, or null, and
it is not kept if an identified row is; rows that repeat a doc_id are judged by
their own text; without rows no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorlint.llm.common import bit_table, merged
from vectorlint.llm.components import components
from vectorlint.llm.words import shingles, word_hashes
from vectorlint.session import materialize

SHINGLE = 4
PERCENT = 80
COORDINATES = 32
MATCHES = 14
SHORT = 32
#: Nodes of a long list that are compared at a time.
BLOCK = 256
#: Families whose sizes are broadcast (some 40 bytes each); more of them are joined by salted keys.
FAMILIES = 100_000
SALTS = 16
#: Bits of the table that lets the sets of open families through.
MEMBER_BITS = 22
SEED = 20260303

_random = np.random.default_rng(SEED)
_TIMES = _random.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _random.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def shingle_set(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return np.unique(shingles(word_hashes(text), n)) if text else np.zeros(0, np.uint64)


def signature(items: np.ndarray) -> np.ndarray:
    """Smallest 32-bit hash of the set under each coordinate's function."""
    out = np.empty(COORDINATES, np.uint32)
    for k in range(COORDINATES):
        out[k] = ((items * _TIMES[k] + _PLUS[k]) >> np.uint64(32)).min()
    return out


def _signatures(docs: DataFrame, shingle: int) -> DataFrame:
    def work(batches):
        for b in batches:
            sizes, keys, sigs = [], [], []
            column = b.column("text")
            for i in range(b.num_rows):
                s = shingle_set(column[i].as_py(), shingle)
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s).view(np.int32) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))], names=["doc_id", "text_key", "n_shingles", "set_key", "signature"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(work, f"doc_id {dict(docs.dtypes)['doc_id']}, text_key bigint, n_shingles bigint, set_key binary, signature array<int>")


def _postings(nodes: DataFrame) -> DataFrame:
    """(coordinate, value, node) of every node's prefix of shared pairs."""
    pairs = nodes.select("node", F.posexplode("signature").alias("coordinate", "value"))
    shared = pairs.groupBy("coordinate", "value").agg(F.count("*").alias("n")).where("n > 1")
    own = (pairs.join(merged(shared), ["coordinate", "value"])
           .groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "coordinate", "value"))).alias("own"))   # at most COORDINATES
           .where(F.size("own") >= MATCHES))
    return own.select("node", F.explode(F.slice("own", 1, F.size("own") - (MATCHES - 1))).alias("p")).select("p.coordinate", "p.value", "node")


def _confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that agree in enough coordinates and whose sets are similar enough."""
    sig = nodes.select("node", "signature", "n_shingles", "set_key")
    p = (pairs.join(sig.toDF("a", "sa", "na", "ka"), "a").join(sig.toDF("b", "sb", "nb", "kb"), "b")
         .where(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)")
         .where(f"aggregate(zip_with(sa, sb, (x, y) -> if(x = y, 1, 0)), 0, (s, x) -> s + x) >= {MATCHES}"))
    full = sets.select("set_key", "items")
    both = p.select("a", "b", "na", "nb", "ka", "kb").join(full.toDF("ka", "xa"), "ka").join(full.toDF("kb", "xb"), "kb").withColumn("common", F.size(F.array_intersect("xa", "xb")).cast("bigint"))
    return both.where(f"100 * common >= {PERCENT} * (na + nb - common)").select("a", "b")


def _block_links(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Links that join components between the asking and the other nodes of a block."""
    ask = table.column("asks").to_numpy(zero_copy_only=False)
    label = table.column("label").to_numpy()
    lists = table.column("items").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    _, word, seen = np.unique(flat, return_inverse=True, return_counts=True)
    row, keep = np.repeat(np.arange(len(sizes)), sizes), seen[word] > 1
    row, word = row[keep], np.unique(word[keep], return_inverse=True)[1] if keep.any() else word[:0]
    place = np.cumsum(ask) - 1, np.cumsum(~ask) - 1
    common = np.zeros((int(ask.sum()), int((~ask).sum())), np.float32)
    step = 20_000
    order = np.argsort(word, kind="stable")
    row, word = row[order], word[order]
    for first in range(0, int(word[-1]) + 1 if len(word) else 0, step):
        lo, hi = np.searchsorted(word, (first, first + step))
        r, w = row[lo:hi], word[lo:hi] - first
        q, m = np.zeros((common.shape[0], step), np.float32), np.zeros((common.shape[1], step), np.float32)
        q[place[0][r[ask[r]]], w[ask[r]]] = 1
        m[place[1][r[~ask[r]]], w[~ask[r]]] = 1
        common += q @ m.T
    na, nb = sizes[ask], sizes[~ask]
    linked = (100 * common >= PERCENT * (na[:, None] + nb[None] - common)) & (label[ask][:, None] != label[~ask][None])
    links = np.unique(np.stack([label[ask][np.nonzero(linked)[0]], label[~ask][np.nonzero(linked)[1]]], 1), axis=0)
    parent: dict[int, int] = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    out = []
    for a, b in links.tolist():
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})


def _finish(long_lists: DataFrame, labels: DataFrame, nodes: DataFrame, sets: DataFrame, once: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """Links between components that long lists still have to compare (None: nothing to compare)."""
    listed = long_lists.join(merged(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = listed.groupBy("coordinate", "value").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min("node").alias("first")).where("x <> y")
    open_lists = materialize(listed.join(mixed.select("coordinate", "value", "first"), ["coordinate", "value"]), "open-lists")
    if open_lists.isEmpty():
        return None
    family = components(open_lists.select(F.col("first").alias("a"), F.col("node").alias("b"))).withColumnRenamed("label", "family")
    member = materialize(open_lists.select("node", "label").distinct().join(merged(family), "node"), "families")
    counts = member.groupBy("family", "label").agg(F.count("*").alias("n"))
    major = counts.groupBy("family").agg(F.max("n").alias("top"), F.sum("n").alias("n")).join(counts.select("family", "label", F.col("n").alias("top")), ["family", "top"])
    major = major.groupBy("family").agg(F.min("label").alias("major"), F.max("n").alias("n"), F.max("top").alias("top"))
    # Blocks of the asking nodes (outside the family's largest component) and of all nodes.
    major = materialize(major, "major")
    if major.count() <= FAMILIES:
        sized = member.join(F.broadcast(major), "family")
    else:       # one family may hold most nodes
        salted = major.withColumn("salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
        sized = member.withColumn("salt", F.expr(f"cast(pmod(xxhash64(node), {SALTS}) as int)")).join(merged(salted), ["family", "salt"]).drop("salt")
    m = (sized.withColumn("asking", F.expr(f"cast(ceil((n - top) / {BLOCK}) as int)")).withColumn("all", F.expr(f"cast(ceil(n / {BLOCK}) as int)"))
         .withColumn("own", F.xxhash64("node")))
    asks = m.where("label <> major").select("family", "node", "label", F.expr("cast(pmod(own, asking) as int)").alias("i"), F.explode(F.expr("sequence(0, `all` - 1)")).alias("j"), F.lit(True).alias("asks"))
    others = m.select("family", "node", "label", F.explode(F.expr("sequence(0, asking - 1)")).alias("i"), F.expr("cast(pmod(own, `all`) as int)").alias("j"), F.lit(False).alias("asks"))
    # A bit table keeps the sets of all other nodes from being sent.
    keys = nodes.join(member.select("node").distinct(), "node", "left_semi").select("node", "set_key")
    keys = materialize(keys, "member-keys")
    table = bit_table(keys.select(F.xxhash64("set_key").alias("h")), "h", MEMBER_BITS)

    def passing(batches):
        pass_ = table.value
        for b in batches:
            at = pass_[b.column("h").to_numpy().view(np.uint64) >> np.uint64(64 - MEMBER_BITS)]
            yield b.select(["set_key", "items"]).filter(pa.array(at))

    own = sets.select("set_key", "items", F.xxhash64("set_key").alias("h")).mapInArrow(passing, "set_key binary, items array<bigint>")
    own = once(own).join(keys, "set_key").select("node", "items")
    blocks = asks.unionByName(others).join(own, "node")
    return blocks.groupBy("family", "i", "j").applyInArrow(_block_links, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key (hash of its text) of every row."""
    signed = materialize(_signatures(docs, shingle), "signatures")
    doc_type = dict(docs.dtypes)["doc_id"]
    # size and signature are the same in all rows of a class
    nodes = (signed.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
             .withColumn("node", F.monotonically_increasing_id()))
    nodes = materialize(nodes, "nodes")
    classes = nodes.select("node", "set_key", "first_id")
    posted = materialize(_postings(nodes), "postings")
    lists = posted.groupBy("coordinate", "value").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1")
    listed = materialize(posted.join(merged(lists), ["coordinate", "value"]), "lists")
    left = listed.where(f"n <= {SHORT}").select("coordinate", "value", F.col("node").alias("a"))
    short = left.join(merged(left.withColumnRenamed("a", "b")), ["coordinate", "value"]).where("a < b").select("a", "b")
    star = listed.where(f"n > {SHORT} AND node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    pairs = short.unionByName(star).distinct()

    # Full sets of the listed nodes only; a bit table keeps the others from being sent.
    wanted = materialize(nodes.join(listed.select("node").distinct(), "node", "left_semi"), "wanted")
    table = bit_table(wanted.select(F.xxhash64("first_id").alias("h")), "h", 24)

    def full(batches):
        pass_ = table.value
        for b in batches:
            at = np.flatnonzero(pass_[b.column("h").to_numpy().view(np.uint64) >> np.uint64(40)])
            texts = b.column("text")
            got = [shingle_set(texts[i].as_py(), shingle) for i in at.tolist()]
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in got]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([s.view(np.int64) for s in got], pa.list_(pa.int64()))], names=["set_key", "items"])

    # What the bit table lets through besides is met by no pair.
    sets = docs.select(F.xxhash64("doc_id").alias("h"), "text").mapInArrow(full, "set_key binary, items array<bigint>")
    sets = materialize(sets, "sets")
    # An id may come in several rows, a set in several let through: one row per set is enough.
    repeated = not sets.groupBy("set_key").count().where("count > 1").isEmpty()

    def once(some: DataFrame) -> DataFrame:
        return some.dropDuplicates(["set_key"]) if repeated else some

    labels = components(_confirmed(pairs, wanted, once(sets)))
    more = _finish(listed.where(f"n > {SHORT}").select("coordinate", "value", "node"), labels, wanted, sets, once)
    if more is not None:
        joined = components(more).select(F.col("node").alias("label"), F.col("label").alias("final"))
        labels = labels.join(merged(joined), "label", "left").select("node", F.coalesce("final", "label").alias("label")).unionByName(
            joined.select(F.col("label").alias("node"), F.col("final").alias("label"))).distinct()
    grouped = classes.join(merged(labels), "node", "left").select("set_key", "first_id", F.coalesce("label", "node").alias("label"))
    component = grouped.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of = grouped.join(component, "label").select(F.col("set_key").alias("of_key"), F.col("component_id").cast(doc_type).alias("found"))
    out = signed.select("doc_id", "text_key", "n_shingles", "set_key").join(of, F.col("set_key") == F.col("of_key"), "left")
    component_id = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("found"))
    return out.select("doc_id", "n_shingles", component_id.alias("component_id"), component_id.eqNullSafe(F.col("doc_id")).alias("kept"), "text_key")
