"""Extendible hashing into byte-limited shards.

Rows hash to 192 bits: 64 of the id, 64 of the text and 64 of the row's place, so
that any two rows differ in some bit.  The directory is indexed by the leading bits; a bucket
over the byte limit splits on its next bit, and the others stay whole.  Bits past
the first 64 matter only where rows of one id are over the limit.  Only
(prefix, bytes) histograms take part in splitting, pre-summed on the map side;
rows themselves move once, for the final directory lookup.

The histogram is taken at ``step`` bits below the deepest open bucket, so that a
round settles ``step`` splits; buckets still too large open a further round of twice as
many, without a limit on rounds short of the last bit.

Defined results: a null text weighs 0 bytes; a row without an id
hashes by its text instead; equal rows are told apart by their place in the input, so which
of them goes where follows its files; a single row over the limit stays alone in
its bucket and is marked ``oversized``; a very long text is only hashed and measured;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

BITS = 192


def prefix(h: Column, depth: Column | int) -> Column:
    """The leading ``depth`` bits of a hash, a string of 0 and 1."""
    return F.left(h, F.lit(depth) if isinstance(depth, int) else depth)


def directory(rows: DataFrame, limit: int, step: int = 6) -> DataFrame:
    """Buckets (``__prefix``, ``__depth``, bytes, rows) that cover all hashes in
    ``rows(__h, __bytes)``; every one fits ``limit`` or holds a single row."""
    total = rows.agg(F.sum("__bytes")).first()[0] or 0
    depth = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + step)
    settled: DataFrame | None = None
    todo = rows
    floor = 0
    while True:
        cells = todo.groupBy(prefix(F.col("__h"), depth).alias("cell")).agg(F.sum("__bytes").alias("b"), F.count(F.lit(1)).alias("n"))
        levels = (
            cells.select(F.explode(F.sequence(F.lit(floor), F.lit(depth))).alias("d"), "cell", "b", "n")
            .groupBy("d", F.expr("left(cell, d)").alias("p"))
            .agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
        )
        levels = cut(levels, "directory")
        parents = levels.select((F.col("d") + 1).alias("d"), F.col("p").alias("up"), F.col("b").alias("ub"), F.col("n").alias("un"))
        nodes = (
            levels.withColumn("up", F.expr("left(p, d - 1)"))
            .join(parents, ["d", "up"], "left")
            .where(F.col("ub").isNull() | ((F.col("ub") > limit) & (F.col("un") > 1)))
        )
        fits = nodes.where((F.col("b") <= limit) | (F.col("n") == 1) | (F.col("d") == BITS))
        # a cell whose parent was over the limit, and which is over it itself, goes on
        leaves = fits.select(F.col("p").alias("__prefix"), F.col("d").cast("int").alias("__depth"), "b", "n")
        settled = leaves if settled is None else settled.unionByName(leaves)
        if depth >= BITS:
            return settled
        over = nodes.where((F.col("b") > limit) & (F.col("n") > 1) & (F.col("d") == depth)).select(F.col("p").alias("__over"))
        if over.isEmpty():
            return settled
        todo = cut(todo.withColumn("__over", prefix(F.col("__h"), depth)).join(over, "__over", "left_semi").drop("__over"), "oversized")
        step *= 2
        floor, depth = depth + 1, min(BITS, depth + step)


def assign(docs: DataFrame, limit: int, doc_id: str = "doc_id", text: str = "text", step: int = 6) -> DataFrame:
    """doc_id, n_bytes, shard (the bucket's prefix), depth, shard_bytes, shard_rows, oversized."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.col(text), F.lit(""))
    place = F.md5(F.monotonically_increasing_id().cast("string"))
    bits = [F.lpad(F.conv(h, 16, 2), 64, "0") for h in (F.left(F.md5(key), F.lit(16)), F.hex(F.xxhash64(F.col(text))), F.left(place, F.lit(16)))]
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint").alias("__bytes"),
        F.concat(*bits).alias("__h"),
    )
    rows = cut(rows, "shard-rows")
    tree = cut(directory(rows.select("__h", "__bytes"), limit, step), "shards")
    least = tree.agg(F.min("__depth")).first()[0] or 0
    tree = tree.withColumn("__slot", prefix(F.col("__prefix"), least))
    rows = rows.withColumn("__slot", prefix(F.col("__h"), least))
    return rows.join(tree, (rows["__slot"] == tree["__slot"]) & F.startswith(F.col("__h"), F.col("__prefix"))).select(
        "doc_id", F.col("__bytes").alias("n_bytes"), F.col("__prefix").alias("shard"), F.col("__depth").alias("depth"),
        F.col("b").alias("shard_bytes"), F.col("n").alias("shard_rows"), (F.col("b") > limit).alias("oversized"),
    )
