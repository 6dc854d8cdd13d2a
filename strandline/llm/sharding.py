"""Sharding by extendible hashing.

The directory is indexed by the leading bits of a hash of the key.  A bucket
whose bytes exceed the limit splits on its next bit, and only such buckets do.
All splits that a stretch of bits can need are settled from one histogram of
that stretch (no text moves), so the number of passes follows the depth of the
deepest bucket divided by the stretch, not the number of splits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import cut, whole_row

#: Bits of the hash; a bucket that is too large here holds rows of one key.
HASH_BITS = 60


def hash_bits(key: Column) -> Column:
    """The first 60 bits of md5 of the key as text; null hashes as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _bits(prefix: Column, depth: Column) -> Column:
    """``prefix`` as a text of ``depth`` binary digits."""
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.bin(prefix), depth, "0"))


def extendible_shards(docs: DataFrame, *, max_bytes: int, id_col: str = "doc_id", text_col: str = "text", stretch: int | None = None) -> DataFrame:
    """One row per input row: doc_id, n_bytes, shard, depth, shard_bytes, shard_rows, oversized.

    ``shard`` is the bucket's hash prefix as binary digits ("" while one bucket
    holds all).  ``oversized`` marks what no split can mend: rows of a single
    key (or a single row) above the limit.  Null texts have 0 bytes, null ids
    share one bucket; an empty table gives no rows.
    """
    if max_bytes < 1:
        raise ValueError("max_bytes is at least 1")
    n_bytes = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), n_bytes.alias("n_bytes"), hash_bits(F.col(id_col)).alias("_h")), "sized")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    step = stretch or min(30, max(4, math.ceil(math.log2(total / max_bytes + 1)) + 4))
    done, open_rows, below = None, rows, 0
    while True:
        upto = min(HASH_BITS, below + step)
        found, left = _settle(open_rows, below, upto, max_bytes)
        done = found if done is None else done.unionByName(found)
        if upto == HASH_BITS or left.isEmpty():
            return done
        open_rows, below = left, upto


def _settle(rows: DataFrame, below: int, upto: int, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose bucket fits at a depth from ``below`` to ``upto``, and the others."""
    rows = rows.withColumn("_p", F.shiftright("_h", HASH_BITS - upto))
    histogram = rows.groupBy("_p").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"), F.min("_h").alias("lo"), F.max("_h").alias("hi"))
    levels = histogram.select("*", F.explode(F.sequence(F.lit(below), F.lit(upto))).alias("depth"))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(_p, {upto} - depth)"))
    buckets = levels.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    last = upto == HASH_BITS
    fits = buckets.where((F.col("shard_bytes") <= max_bytes) | (F.col("lo") == F.col("hi")) | (F.lit(last) & (F.col("depth") == upto)))
    # A prefix's leaf is the shallowest bucket above it that fits.
    leaf = levels.select("_p", "depth", "prefix").join(fits.drop("lo", "hi"), ["depth", "prefix"])
    leaf = leaf.groupBy("_p").agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_rows")).alias("leaf"))
    leaf = cut(leaf, "directory")
    joined = rows.join(leaf, "_p", "left")
    found = joined.where("leaf is not null").select(
        "doc_id",
        "n_bytes",
        _bits(F.col("leaf.prefix"), F.col("leaf.depth")).alias("shard"),
        F.col("leaf.depth").alias("depth"),
        F.col("leaf.shard_bytes").alias("shard_bytes"),
        F.col("leaf.shard_rows").alias("shard_rows"),
        (F.col("leaf.shard_bytes") > max_bytes).alias("oversized"),
    )
    return found, joined.where("leaf is null").select("doc_id", "n_bytes", "_h")


def write_shards(docs: DataFrame, path: str, *, max_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write every row of ``docs`` below ``path``, one folder a shard, and return the name of the
    folders' column: ``shard_id``, with underscores before it where ``docs`` has such a column.

    Rows of a shard that no split could mend are dealt over as many tasks as their bytes ask for.
    """
    name = "shard_id"
    while name in docs.columns:
        name = f"_{name}"
    shards = extendible_shards(docs, max_bytes=max_bytes, id_col=id_col, text_col=text_col)
    tasks = F.when(F.col("oversized"), F.ceil(F.col("shard_bytes") / max_bytes)).otherwise(1)
    where = shards.select(F.col("doc_id").alias("key"), F.concat(F.lit("b"), "shard").alias("shard"), tasks.alias("tasks")).distinct()
    rows = docs.select(whole_row(docs), F.col(id_col).alias("id"), (F.xxhash64(F.col(text_col)) + F.spark_partition_id()).alias("salt"))
    rows = rows.join(where, rows["id"].eqNullSafe(where["key"])).withColumn("task", F.pmod("salt", "tasks"))
    rows.repartition("shard", "task").select("row.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(path)
    return name
