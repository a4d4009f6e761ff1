"""Operator 11: hard negatives for anchors by segment summaries.

A row's score is its integer inner product with the anchor.  An anchor's
positives are its ``POSITIVES`` best other rows of its label; a positive's
negatives are the ``NEGATIVES`` best rows of other labels whose score lies
between ``LOW`` and ``HIGH`` percent of the positive's.

1. Grid.  Rows are dealt by a hash to blocks, anchors to groups, both of bounded
   bytes; every group meets every block in one task, however often a label or a
   vector comes.  Two passes: positives, then negatives.
2. Summaries.  A vector is cut into segments; each keeps its mean and its
   deviation (the length of what is left after the mean is taken away).  By
   Cauchy and Schwarz a segment's part of a score lies within the product of the
   means plus or minus the product of the deviations.  The bounds are taken with
   few segments first, then with more for the pairs that remain (``SEGMENTS``).
   A pair goes when its upper bound is below what the anchor has already, or its
   bounds miss the asked range.
3. Exact scores for the rest; the best of each block, then the best of all.

Defined results: rows with a null label, a null vector, or a null or non-finite
component take no part; in vectors of unequal length missing components count as
zero; a null vec_id is no anchor and comes last in ties; rows that repeat a vec_id
are rows of their own, ordered by the place where they are stored, and only the
anchor's own row is no "other" row; scores are exact up to 64 bits (larger ones
count as the largest number of 64 bits); without rows no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vectorlint.session import materialize

ANCHOR_EVERY = 50
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95
SCALE = 256
#: Segments of the summaries, from the coarsest level to the finest.
SEGMENTS = (1, 4, 16)
#: Bytes of vectors (8 a component) in a group of anchors and in a block of rows.
GROUP_BYTES = 16 << 20
BLOCK_BYTES = 32 << 20
#: Anchors and rows that are compared at a time.
ANCHORS, ROWS = 256, 4096
#: Share of remaining pairs from which on a whole matrix is computed.
DENSE = 0.1
_LAST = np.iinfo(np.int64).max


def vectors(embeddings: DataFrame) -> DataFrame:
    """row, vec_id, label, v (integer components) of the rows that take part."""
    x = embeddings.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), F.col("embedding").cast("array<double>").alias("e"))
    x = x.where("label IS NOT NULL AND e IS NOT NULL AND NOT exists(e, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))")
    x = x.select("vec_id", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END").alias("label"), F.expr(f"transform(e, x -> floor({SCALE}D * x))").alias("v"))
    return materialize(x.withColumn("row", F.monotonically_increasing_id()), "vectors")


def _matrix(lists: pa.Array, dim: int, exact: type) -> np.ndarray:
    """Rows of integer components, filled up with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), dim), exact)
    flat = lists.flatten().to_numpy()
    if exact is object:
        flat = np.array(flat.tolist(), object)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = flat
    return out


def summaries(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(means, deviations) of the segments on each level; a mean is multiplied by
    the root of the segment's size, so that products need no weights."""
    x, dim, out = x.astype(float), x.shape[1], []
    for k in SEGMENTS:
        cut = np.unique(np.arange(min(k, dim)) * dim // min(k, dim)) if dim else np.zeros(0, int)
        size = np.diff(np.r_[cut, dim])
        if not dim:
            out.append((np.zeros((len(x), 1)), np.zeros((len(x), 1))))
            continue
        total = np.add.reduceat(x, cut, axis=1)
        left = x - np.repeat(total / size, size, axis=1)
        out.append((total / np.sqrt(size), np.sqrt(np.add.reduceat(left * left, cut, axis=1))))
    return out


class Side:
    """Vectors of some rows with their keys and summaries."""

    def __init__(self, row, id_, label, x, levels=None):
        self.row, self.id, self.label, self.x = row, id_, label, x
        self.levels = summaries(x) if levels is None else levels

    def __len__(self):
        return len(self.row)

    def take(self, at) -> Side:
        return Side(self.row[at], self.id[at], self.label[at], self.x[at], [(m[at], d[at]) for m, d in self.levels])

    def parts(self, n: int) -> Iterator[Side]:
        for lo in range(0, len(self), n):
            yield self.take(slice(lo, lo + n))


def surviving(a: Side, r: Side, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) and their exact scores: all whose score is within low[i]..high[i], and some others."""
    i = j = None
    for (ma, da), (mr, dr) in zip(a.levels, r.levels):
        dense = i is None or len(i) > DENSE * len(a) * len(r)
        if dense:
            mid, dev = ma @ mr.T, da @ dr.T
            slack = 1e-9 * (np.abs(mid) + dev) + 1e-6
            keep = (mid + dev + slack >= low[:, None]) & (mid - dev - slack <= high[:, None])
            if i is None:
                i, j = np.nonzero(keep)
                continue
            keep = keep[i, j]
        else:
            mid, dev = np.einsum("ij,ij->i", ma[i], mr[j]), np.einsum("ij,ij->i", da[i], dr[j])
            slack = 1e-9 * (np.abs(mid) + dev) + 1e-6
            keep = (mid + dev + slack >= low[i]) & (mid - dev - slack <= high[i])
        i, j = i[keep], j[keep]
    if a.x.dtype == object or len(i) > DENSE * len(a) * len(r):
        score = (a.x @ r.x.T)[i, j]
    else:
        score = np.empty(len(i))
        for lo in range(0, len(i), 1 << 17):
            score[lo:lo + (1 << 17)] = np.einsum("ij,ij->i", a.x[i[lo:lo + (1 << 17)]], r.x[j[lo:lo + (1 << 17)]])
    return i, j, score if score.dtype == object else score.astype(np.int64)


def best(key: np.ndarray, score: np.ndarray, id_: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` entries of each key, in order: higher scores, smaller ids, earlier rows."""
    down = -score
    if score.dtype == object:                               # lexsort needs numbers of 64 bits
        down = np.unique(down, return_inverse=True)[1]
    order = np.lexsort((row, id_, down, key))
    new = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(key) else np.zeros(0, int)
    place = np.arange(len(key)) - np.repeat(new, np.diff(np.r_[new, len(key)]))
    return order[place < k]


def _kth(key: np.ndarray, score: np.ndarray, k: int, n: int) -> np.ndarray:
    """The k-th score of each key 0..n-1 of ordered entries, -inf where there are fewer."""
    out = np.full(n, -np.inf)
    count = np.bincount(key, minlength=n)
    full = np.flatnonzero(count >= k)
    out[full] = score[(np.cumsum(count) - count)[full] + k - 1].astype(float)
    return out


def _lowest(x: np.ndarray) -> np.ndarray:
    """Scores as floats, a little lower, so that rounding never excludes a tie."""
    return x - np.abs(np.where(np.isfinite(x), x, 0)) * 1e-12


def positives_in(a: Side, r: Side) -> tuple[np.ndarray, ...]:
    """(anchor, row, score) places of the best rows of each anchor's label in a block."""
    out = [], [], []
    for label in np.unique(a.label):
        mine, theirs = np.flatnonzero(a.label == label), r.take(np.flatnonzero(r.label == label))
        place = np.flatnonzero(r.label == label)
        for lo in range(0, len(mine), ANCHORS):
            at = mine[lo:lo + ANCHORS]
            some = a.take(at)
            low, high = np.full(len(some), -np.inf), np.full(len(some), np.inf)
            key, row, score = np.zeros(0, int), np.zeros(0, int), np.zeros(0, some.x.dtype if some.x.dtype == object else np.int64)
            first = 0
            for part in theirs.parts(ROWS):
                i, j, s = surviving(some, part, _lowest(low), high)
                other = some.row[i] != part.row[j]
                key, row, score = np.r_[key, i[other]], np.r_[row, j[other] + first], np.r_[score, s[other]]
                first += len(part)
                k = best(key, score, theirs.id[row], theirs.row[row], POSITIVES)
                key, row, score = key[k], row[k], score[k]
                low = _kth(key, score, POSITIVES, len(some))
            for o, x in zip(out, (at[key], place[row], score)):
                o.append(x)
    return tuple(np.concatenate(o) if o else np.zeros(0, int) for o in out)


def asked(score: int) -> tuple[float, float]:
    """Range of the negatives' scores for a positive's."""
    return -(-LOW * score // 100), HIGH * score // 100


def negatives_in(a: Side, r: Side, wanted: list[list[int]]) -> tuple[np.ndarray, ...]:
    """(anchor, positive, row, score) places of the best negatives in a block; ``wanted``:
    the positives' scores of each anchor."""
    out = [], [], [], []
    for lo in range(0, len(a), ANCHORS):
        some, mine = a.take(slice(lo, lo + ANCHORS)), wanted[lo:lo + ANCHORS]
        exact = object if some.x.dtype == object else np.int64
        least, most = np.ones((len(some), POSITIVES), exact), np.zeros((len(some), POSITIVES), exact)        # no score is asked for
        for i, scores in enumerate(mine):
            for p, s in enumerate(scores):
                least[i, p], most[i, p] = asked(int(s))
        none = least > most
        high = np.where(none, -np.inf, most.astype(float)).max(1)
        low = np.where(none, np.inf, least.astype(float))
        kth = np.full(low.shape, -np.inf)
        key, row, score = np.zeros(0, int), np.zeros(0, int), np.zeros(0, exact)
        first = 0
        for part in r.parts(ROWS):
            need = np.maximum(low, kth).min(1)
            i, j, s = surviving(some, part, _lowest(need), high + np.abs(np.where(np.isfinite(high), high, 0)) * 1e-12)
            other = some.label[i] != part.label[j]
            i, j, s = i[other], j[other], s[other]
            n, p = np.nonzero((least[i] <= s[:, None]) & (s[:, None] <= most[i]))
            key, row, score = np.r_[key, i[n] * POSITIVES + p], np.r_[row, j[n] + first], np.r_[score, s[n]]
            first += len(part)
            k = best(key, score, r.id[row], r.row[row], NEGATIVES)
            key, row, score = key[k], row[k], score[k]
            kth = _kth(key, score, NEGATIVES, len(some) * POSITIVES).reshape(-1, POSITIVES)
        for o, x in zip(out, (key // POSITIVES + lo, key % POSITIVES, row, score)):
            o.append(x)
    return tuple(np.concatenate(o) if o else np.zeros(0, int) for o in out)


def _sides(table: pa.Table, dim: int, exact: type) -> tuple[Side, Side, pa.Table]:
    """Anchors and rows of a cell of the grid, and the anchors' table."""
    sides = []
    for anchor in (True, False):
        t = table.filter(pa.array(table.column("anchor").to_numpy(zero_copy_only=False) == anchor))
        sides.append(Side(t.column("row").to_numpy(), pc.fill_null(t.column("vec_id"), _LAST).to_numpy(), t.column("label").to_numpy(), _matrix(t.column("v").combine_chunks(), dim, exact)))
        if anchor:
            anchors = t
    return sides[0], sides[1], anchors


def _numbers(score: np.ndarray) -> pa.Array:
    return pa.array([min(max(int(s), -2 ** 63), 2 ** 63 - 1) for s in score] if score.dtype == object else score, pa.int64())


def _ids(side: Side, at: np.ndarray) -> pa.Array:
    return pa.array(side.id[at], pa.int64(), mask=side.id[at] == _LAST)


def _positives(dim: int, exact: type) -> Callable:
    def work(table: pa.Table) -> pa.Table:
        a, r, _ = _sides(table, dim, exact)
        i, j, score = positives_in(a, r)
        return pa.table({"anchor_row": pa.array(a.row[i], pa.int64()), "positive_id": _ids(r, j), "positive_row": pa.array(r.row[j], pa.int64()), "positive_score": _numbers(score)})

    return work


def _negatives(dim: int, exact: type) -> Callable:
    def work(table: pa.Table) -> pa.Table:
        a, r, anchors = _sides(table, dim, exact)
        i, p, j, score = negatives_in(a, r, anchors.column("scores").to_pylist())
        return pa.table({"anchor_row": pa.array(a.row[i], pa.int64()), "place": pa.array(p, pa.int32()), "negative_id": _ids(r, j), "negative_row": pa.array(r.row[j], pa.int64()), "negative_score": _numbers(score)})

    return work


def _grid(rows: DataFrame, anchors: DataFrame, groups: int, blocks: int) -> DataFrame:
    """Every group of anchors beside every block of rows: (g, j) and the columns of ``anchors``."""
    def dealt(n: int, salt: int):
        return F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    there = rows.withColumn("j", dealt(blocks, 1)).withColumn("g", every(groups)).withColumn("anchor", F.lit(False))
    here = anchors.withColumn("g", dealt(groups, 2)).withColumn("j", every(blocks)).withColumn("anchor", F.lit(True))
    return here.unionByName(there, allowMissingColumns=True).groupBy("g", "j")


def mine(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = vectors(embeddings)
    anchors = rows.where(f"vec_id % {ANCHOR_EVERY} = 0")
    top = rows.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % ANCHOR_EVERY == 0).alias("anchors"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dim"),
                   F.max(F.expr("aggregate(v, 0D, (m, x) -> greatest(m, abs(double(x))))")).alias("most")).first()
    dim, n = max(top["dim"], 1), top["n"]
    exact = float if dim * (top["most"] or 0.0) ** 2 < 2 ** 53 else object
    groups = -(-max(top["anchors"], 1) * dim * 8 // GROUP_BYTES)
    blocks = max(1, -(-n * dim * 8 // BLOCK_BYTES), min(rows.sparkSession.sparkContext.defaultParallelism, n // 1024))
    found = _grid(rows, anchors, groups, blocks).applyInArrow(_positives(dim, exact), "anchor_row bigint, positive_id bigint, positive_row bigint, positive_score bigint")
    order = Window.partitionBy("anchor_row").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"), "positive_row")
    positives = materialize(found.withColumn("place", F.row_number().over(order) - 1).where(f"place < {POSITIVES}"), "positives")
    scores = positives.groupBy("anchor_row").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "positive_score"))), lambda s: s["positive_score"]).alias("scores"))     # at most POSITIVES
    asking = anchors.join(scores, F.col("row") == F.col("anchor_row")).drop("anchor_row")
    found = _grid(rows, asking, groups, blocks).applyInArrow(_negatives(dim, exact), "anchor_row bigint, place int, negative_id bigint, negative_row bigint, negative_score bigint")
    order = Window.partitionBy("anchor_row", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "negative_row")
    negatives = found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {NEGATIVES}")
    out = negatives.join(positives, ["anchor_row", "place"]).join(anchors.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id")), "anchor_row")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def oracle() -> str:
    """DuckDB twin of ``mine`` (distinct ids, vectors of one length)."""
    return f"""
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {ANCHOR_EVERY} = 0),
    p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES}),
    n AS (SELECT p.*, s.other_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same WHERE {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""
