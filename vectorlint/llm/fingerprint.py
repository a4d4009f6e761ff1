"""Operator 9: document fingerprints by one-permutation MinHash, in Spark functions only.

Each five-word shingle of a text is hashed once.  The hash's leading bits name
one of ``BINS`` bins, and every bin keeps its smallest hash (one sort puts the
bins side by side).  An empty bin takes the value of the first filled one on
its own fixed random walk over the bins (optimal densification).  Of each bin
``BITS`` low-order bits, rehashed with the bin's number so that copied values
stay independent, are packed into the fingerprint.  Two unlike bins agree by
chance once in 2^BITS, which the likeness corrects.

Defined results: null counts as empty; a text without words has the
fingerprint of zeros; with fewer than five words the whole sequence is one
shingle; equal texts have equal fingerprints, and likeness 1; rows that repeat
a doc_id follow each other by a hash of the text; rows without doc_id come
after all others; a single row is its own next; empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
BINS = 128
BITS = 4
SEED = 20260304
#: Rows of a run of neighbouring ids that one window works on, and runs at most.
RUN_ROWS = 500
MAX_RUNS = 100_000

_SHIFT = 64 - int(math.log2(BINS))
_PER_WORD = 64 // BITS
_WORDS = BINS // _PER_WORD


#: Steps of an empty bin's walk that are tried one by one; a bin that finds
#: nothing (few bins are filled then) looks for the filled bin that comes first.
STEPS = 12


def _walks() -> tuple[str, str]:
    """Literal arrays: each bin's random order of all bins, and its inverse."""
    r = np.random.default_rng(SEED)
    walks = [r.permutation(BINS) for _ in range(BINS)]
    return tuple("array(" + ", ".join("array(" + ", ".join(map(str, w.tolist())) + ")" for w in x) + ")" for x in (walks, [np.argsort(w) for w in walks]))


def add_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: array<bigint>, the packed fingerprint of string column
    ``text`` (which holds no null).  Adds no other column."""
    t = [f"__{out}_{k}" for k in range(6)]
    keep = [F.col(f"`{c}`") for c in df.columns]
    words = f"transform(filter(split(lower(`{text}`), '[ \\\\t-\\\\r]+'), w -> w <> ''), w -> xxhash64(w))"
    run = ", ".join(f"get({t[0]}, i + {k})" for k in range(SHINGLE))
    df = df.select(*keep, F.expr(words).alias(t[0]))
    df = df.select(*keep, F.expr(f"""sort_array(CASE WHEN size({t[0]}) = 0 THEN cast(array() AS array<bigint>)
        WHEN size({t[0]}) < {SHINGLE} THEN array(xxhash64({t[0]}))
        ELSE transform(sequence(0, size({t[0]}) - {SHINGLE}), i -> xxhash64({run})) END)""").alias(t[1]))
    df = df.select(*keep, F.expr(f"filter({t[1]}, (h, i) -> i = 0 OR shiftrightunsigned(h, {_SHIFT}) <> shiftrightunsigned(get({t[1]}, i - 1), {_SHIFT}))").alias(t[2]))
    df = df.select(*keep, F.col(t[2]), F.expr(f"transform({t[2]}, h -> cast(shiftrightunsigned(h, {_SHIFT}) AS int))").alias(t[3]))
    # Place of each bin's value among the smallest hashes, 0 if the bin is empty.
    df = df.select(*keep, F.col(t[2]), F.col(t[3]), F.expr(f"transform(sequence(0, {BINS - 1}), i -> cast(array_position({t[3]}, i) AS int))").alias(t[4]))
    walks, ranks = _walks()
    tried = " ".join(f"WHEN get({t[4]}, get(walk, {k})) > 0 THEN get({t[4]}, get(walk, {k}))" for k in range(STEPS))
    last = f"get({t[4]}, array_min(transform({t[3]}, j -> get(get({ranks}, i), j) * {BINS} + j)) % {BINS})"
    place = f"CASE WHEN get({t[4]}, i) > 0 THEN get({t[4]}, i) {tried} ELSE {last} END"
    df = df.select(*keep, F.expr(f"transform({walks}, (walk, i) -> (xxhash64(get({t[2]}, {place} - 1), i) & {(1 << BITS) - 1}))").alias(t[5]), F.col(t[3]))
    packed = [f"aggregate(slice({t[5]}, {k * _PER_WORD + 1}, {_PER_WORD}), 0L, (a, d) -> shiftleft(a, {BITS}) | d)" for k in range(_WORDS)]
    return df.select(*keep, F.expr(f"CASE WHEN size({t[3]}) = 0 THEN array_repeat(0L, {_WORDS}) ELSE array({', '.join(packed)}) END").alias(out))


def as_hex(packed: str):
    """The packed fingerprint as lower-case hexadecimal digits."""
    return F.expr("concat(" + ", ".join(f"lpad(lower(hex({packed}[{k}])), 16, '0')" for k in range(_WORDS)) + ")")


def likeness(a: str, b: str):
    """Bias-corrected share of equal bins of two packed fingerprints, 0 to 1."""
    ones = int("0" * (BITS - 1) + "1", 2)
    lowest = sum(ones << BITS * k for k in range(_PER_WORD))
    unlike = " + ".join("bit_count((" + " | ".join(f"shiftrightunsigned({a}[{k}] ^ {b}[{k}], {s})" for s in range(BITS)) + f") & {lowest}L)" for k in range(_WORDS))
    chance = 2.0 ** -BITS
    return F.expr(f"greatest(0.0D, least(1.0D, (({BINS} - ({unlike})) / {float(BINS)}D - {chance}D) / {1 - chance}D))")


def _in_runs(ids: DataFrame):
    """(function that adds run ``__run`` of neighbouring doc_ids, DataFrame of
    each run's top doc_id and the run that its row must also be seen in)."""
    n = ids.count()
    runs = max(1, min(MAX_RUNS, math.ceil(n / RUN_ROWS)))
    cuts = []
    if runs > 1:
        share = F.array(*[F.lit(k / runs) for k in range(1, runs)])
        cuts = sorted({float(x) for x in ids.agg(F.percentile_approx("doc_id", share, 20 * runs)).first()[0] or []})
    splits = [-math.inf, *cuts, math.inf]

    def add(df):
        if len(splits) < 3:
            return df.withColumn("__run", F.when(F.col("doc_id").isNull(), -1).otherwise(0))
        by = Bucketizer(splits=splits, inputCol="__at", outputCol="__bucket")
        return (by.transform(df.withColumn("__at", F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0))))
                .withColumn("__run", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("__bucket").cast("int"))).drop("__at", "__bucket"))

    # One row per run, at most MAX_RUNS: small enough for one window and to broadcast.
    order = Window.orderBy(F.col("__run").desc())
    tops = add(ids).groupBy("__run").agg(F.max("doc_id").alias("__top"))
    tops = tops.select("__top", F.coalesce(F.lag("__run").over(order), F.min("__run").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("__to"))
    return add, tops


def with_next(docs: DataFrame) -> DataFrame:
    """Adds the text and fingerprint of the next row by descending doc_id
    (after the last: the first).

    Ids are cut into runs at approximate quantiles; a window looks ahead within
    a run, and a copy of the first row of the following run closes it."""
    add, tops = _in_runs(docs.select("doc_id"))
    rows = add(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).withColumn("__copy", F.lit(0)).withColumn("__tie", F.xxhash64("text"))
    copies = (rows.join(F.broadcast(tops), rows["doc_id"].eqNullSafe(tops["__top"]))
              .select("doc_id", "text", F.col("__to").alias("__run"), F.lit(1).alias("__copy"), "__tie"))
    both = add_fingerprint(rows.unionByName(copies), "text", "packed")
    ahead = Window.partitionBy("__run").orderBy("__copy", F.col("doc_id").desc_nulls_last(), F.col("__tie"), "text")
    return both.select("*", F.lead("text").over(ahead).alias("next_text"), F.lead("packed").over(ahead).alias("next_packed")).where("__copy = 0").drop("__run", "__copy", "__tie")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    d = with_next(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))
    d = d.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 3 AS int)), substring(next_text, 1, cast(n_chars div 3 AS int)))"))
    d = add_fingerprint(d.drop("text", "next_text"), "edited", "edited_packed")
    return d.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_hex("packed").alias("fingerprint"), as_hex("edited_packed").alias("edited_fingerprint"),
                    likeness("packed", "edited_packed").alias("near_edited"), likeness("packed", "next_packed").alias("near_next"))
