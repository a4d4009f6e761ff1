"""Operator 2: sharding by extendible hashing.

A row's shard is a prefix of the bits of its key's hash.  A directory indexed
by the leading bits holds each bucket's own (local) depth: a bucket whose rows
fit the byte limit, or that is a single row, stays; only oversized buckets are
split on another bit.

The directory is found from byte sums, not by moving rows: one grouped sum per
directory cell (pre-aggregated), rolled up over the shorter prefixes, gives
every cell the shortest prefix that fits.  Cells that don't fit at the
directory's depth are opened for further bits, with their rows only.

Rows whose keys are equal share all ``BITS`` bits; if such a bucket is still
oversized, its rows go on with the bits of a second hash over the row's text
and place in the input, so that one hot key, or copies of one row, fit as well.

Defined results: a null key hashes as an empty one, a null text has 0 bytes; a
single row above the limit is a shard of its own; a table that fits is the one
shard ``""``; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorlint.session import materialize

#: Bits of a hash that may be used, extra directory bits beyond log2(total/limit),
#: and bits that are opened at a time after that.
BITS = 60
SPARE_BITS = 3
STEP_BITS = 8
#: Byte limit of the registered query's shards.
QUERY_LIMIT = 1 << 20

_HASH = "cast(conv(substr(md5({}), 1, 15), 16, 10) AS bigint)"


def _split(rows: DataFrame, limit: int, first_bits: int, by: tuple[str, ...] = (), final: bool = False) -> list[tuple[int, DataFrame]]:
    """Directories [(bits, DataFrame(cell, depth, shard_bytes, shard_rows))] of
    rows (h, n_bytes), one for each value of the columns ``by``; depth is null
    in cells that the next directory opens (if ``final``, not at all ``BITS``)."""
    found, bits, at_depth = [], 0, 0
    left = rows.select(*by, "h", "n_bytes")
    while True:
        bits = min(BITS, bits + (first_bits if not found else STEP_BITS))
        cells = materialize(left.groupBy(*by, F.shiftright("h", BITS - bits).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("r")), "directory-cells")
        rolled = cells.select(*by, "cell", "b", "r", F.explode(F.sequence(F.lit(at_depth), F.lit(bits))).alias("d")).withColumn("prefix", F.expr(f"shiftright(cell, cast({bits} - d AS int))"))
        fits = rolled.groupBy(*by, "d", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("r").alias("shard_rows")).where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.lit(final) & (F.col("d") == BITS)))
        # Of the prefixes of a cell that fit, the shortest is its shard.
        best = (rolled.select(*by, "cell", "d", "prefix").join(fits, [*by, "d", "prefix"]).groupBy(*by, "cell").agg(F.min(F.struct("d", "shard_bytes", "shard_rows")).alias("s"))
                .select(*by, "cell", F.col("s.d").alias("depth"), "s.shard_bytes", "s.shard_rows"))
        directory = materialize(cells.select(*by, "cell").join(best, [*by, "cell"], "left"), "directory")
        found.append((bits, directory))
        shut = directory.where("depth IS NULL").select(*by, "cell")
        if bits == BITS or shut.isEmpty():
            return found
        left = left.withColumn("cell", F.shiftright("h", BITS - bits)).join(shut, [*by, "cell"], "left_semi").drop("cell")
        at_depth = bits + 1


def _place(rows: DataFrame, found: list[tuple[int, DataFrame]], by: tuple[str, ...] = ()) -> DataFrame:
    """Adds depth, shard_bytes, shard_rows; depth is null where no directory has a place."""
    for k, (bits, directory) in enumerate(found):
        d = directory.select(*by, F.col("cell").alias(f"c{k}"), F.col("depth").alias(f"d{k}"), F.col("shard_bytes").alias(f"b{k}"), F.col("shard_rows").alias(f"r{k}"))
        rows = rows.withColumn(f"c{k}", F.shiftright("h", BITS - bits)).join(d, [*by, f"c{k}"], "left")
    for out, x in (("depth", "d"), ("shard_bytes", "b"), ("shard_rows", "r")):
        rows = rows.withColumn(out, F.coalesce(*[F.col(f"{x}{k}") for k in range(len(found))]))
    return rows.drop(*[f"{x}{k}" for x in "cdbr" for k in range(len(found))])


def _bits(h: str, depth: str):
    return F.expr(f"CASE WHEN {depth} = 0 THEN '' ELSE lpad(bin(shiftright({h}, cast({BITS} - {depth} AS int))), cast({depth} AS int), '0') END")


def assign_shards(docs: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """``key``, n_bytes, depth, shard (its bits), shard_bytes, shard_rows of
    every row; shards hold at most ``limit`` bytes of text unless a single row
    has more."""
    rows = docs.select(key, F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
                       F.expr(_HASH.format(f"coalesce(cast(`{key}` AS string), '')")).alias("h"),
                       F.xxhash64("text", F.monotonically_increasing_id()).alias("second"))
    rows = materialize(rows, "shard-keys")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    spread = max(1, math.ceil(math.log2(max(1, total / limit))) + SPARE_BITS)
    found = _split(rows, limit, min(BITS, spread))
    placed = _place(rows, found).withColumn("shard", _bits("h", "depth"))
    columns = [key, "n_bytes", "depth", "shard", "shard_bytes", "shard_rows"]
    bits, last = found[-1]
    if bits < BITS or last.where("depth IS NULL").isEmpty():
        return placed.select(*columns)
    # Buckets of one hot key: their rows go on with the second hash, bit by bit as above.
    hot = placed.where("depth IS NULL").select(F.col(key).alias("hot_key"), "n_bytes", F.col("h").alias("first_hash"), F.shiftrightunsigned("second", 64 - BITS).alias("h"))
    hot = materialize(hot, "hot-keys")
    largest = hot.groupBy("first_hash").agg(F.sum("n_bytes").alias("b")).agg(F.max("b")).first()[0]
    spread = max(1, math.ceil(math.log2(max(1, largest / limit))) + SPARE_BITS)
    parts = _place(hot, _split(hot, limit, min(BITS, spread), ("first_hash",), True), ("first_hash",))
    parts = parts.select(F.col("hot_key").alias(key), "n_bytes", (F.col("depth") + BITS).alias("depth"), F.concat(_bits("first_hash", str(BITS)), _bits("h", "depth")).alias("shard"), "shard_bytes", "shard_rows")
    return placed.where("depth IS NOT NULL").select(*columns).unionByName(parts)


def write_shards(docs: DataFrame, path: str, limit: int, key: str = "doc_id") -> None:
    """Writes every row of ``docs`` below ``path`` in one folder per shard
    (``shard=b<bits>``); rows that share a key must share their row's shard, so
    ``key`` has to be unique here."""
    at = assign_shards(docs.select(key, "text"), limit, key).select(F.col(key).alias("__key"), F.concat(F.lit("b"), "shard").alias("shard"))
    docs.join(at, docs[key].eqNullSafe(at["__key"])).drop("__key").repartition("shard").write.partitionBy("shard").parquet(path)


def oracle(limit: int = QUERY_LIMIT) -> str:
    """DuckDB twin for tables whose keys are unique."""
    return f"""
WITH t AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
d AS (SELECT unnest(range(0, 33)) AS d),
p AS (SELECT d, h >> ({BITS} - d)::INT AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM t, d GROUP BY ALL),
f AS (SELECT doc_id, n_bytes, h, min(d) AS depth FROM t, d JOIN p USING (d) WHERE prefix = h >> ({BITS} - d)::INT AND (shard_bytes <= {limit} OR shard_rows = 1) GROUP BY ALL)
SELECT doc_id, n_bytes, depth::INT AS depth, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> ({BITS} - depth)::INT), depth::INT, '0') END AS shard, shard_bytes, shard_rows
FROM f JOIN p ON p.d = f.depth AND p.prefix = h >> ({BITS} - depth)::INT"""
