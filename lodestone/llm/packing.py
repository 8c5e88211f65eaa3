"""Best-fit packing into sequences of several permitted lengths.

A document's length is its number of UTF-8 bytes (the tokens of a byte-level
vocabulary) or any other length column.  Whole pieces of the largest capacity
stand alone.  What remains of each document is packed: longest first, into the
open bin that it fits most tightly, or else into a new bin.

The capacities are chosen jointly.  A new bin takes, of the capacities in use that hold
the piece, the one that costs least per token that it can still come to hold (its
capacity, or all that is left to pack).  Every non-empty choice of capacities in use is
packed, at the end each bin takes the least permitted capacity that holds its
contents, and the choice whose bins cost least in total is kept.

Remainders are dealt into groups of about ``group_rows`` by a hash of the id, its
text and a copy number, so repeated rows spread as well, and every group is
packed in one task.  The number of groups follows the row count.

Defined results: a null or empty text has length 0 and stands in no bin (null
bin_id); a null id packs like any other; texts of one id are told apart by ``key`` (a hash
of the text) and equal rows by ``copy``, so (doc_id, key, copy, piece) names each piece; a very
long text is cut into whole pieces; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

CAPACITIES = (1024, 2048, 4096, 8192)


def cost(capacity: int, overhead: int = 64, square: int = 65536) -> float:
    """What a sequence of this capacity costs: a fixed part, a linear and a quadratic one."""
    return overhead + capacity + capacity * capacity / square


def best_fit(lengths: list[int], capacities: tuple[int, ...], use: tuple[int, ...]) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each length (given longest first), and the capacity of each bin,
    where new bins have the capacities ``use`` or, if none of them holds the piece, any."""
    sizes, use = sorted(capacities), sorted(use)
    price = {c: cost(c) for c in sizes}
    todo = sum(lengths)
    room: list[tuple[int, int]] = []
    used: list[int] = []
    bins, offsets = [], []
    for n in lengths:
        at = bisect_left(room, (n, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            b = len(used)
            left = min([c for c in use if c >= n] or [c for c in sizes if c >= n], key=lambda c: (price[c] / min(c, todo), c))
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        todo -= n
        if left > n:
            insort(room, (left - n, b))
    return bins, offsets, [min(c for c in sizes if c >= u) for u in used]


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """The cheapest of the packings of all choices of capacities in use."""
    choices = [use for k in range(1, len(capacities) + 1) for use in combinations(sorted(capacities), k)]
    return min((best_fit(lengths, capacities, use) for use in choices), key=lambda packed: sum(map(cost, packed[2])))


#: copies of equal rows listed at once
COPIES = 4096


def _group(capacities: tuple[int, ...]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(__id=rows["doc_id"].astype(str)).sort_values(["n_tokens", "__id", "key", "copy"], ascending=[False, True, True, True], kind="stable")
        bins, offsets, size = pack(rows["n_tokens"].tolist(), capacities)
        group = rows["__g"].iloc[0] if len(rows) else 0
        return rows.assign(bin_id=[f"g{group}.{b}" for b in bins], capacity=[size[b] for b in bins], offset=offsets)[
            ["doc_id", "key", "copy", "piece", "n_tokens", "bin_id", "capacity", "offset"]
        ]

    return run


def _longs(first: Column, stop: Column) -> Column:
    """first, first + 1, ... up to before ``stop``; empty where there is none."""
    return F.when(stop > first, F.sequence(first, stop - 1)).otherwise(F.expr("cast(array() as array<bigint>)"))


def plan(docs: DataFrame, length: Column | None = None, capacities: tuple[int, ...] = CAPACITIES, group_rows: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece: doc_id, key, copy, piece, n_tokens, bin_id, capacity, offset."""
    length = F.octet_length(F.col(text)) if length is None else length
    top, long = max(capacities), "bigint"
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("key"), F.coalesce(length, F.lit(0)).cast(long).alias("n"))
    # copies are numbered in two steps, so that no list has more than a block of them
    counted = rows.groupBy("doc_id", "key", "n").agg(F.count(F.lit(1)).alias("k"))
    blocks = counted.select("doc_id", "key", "n", "k", F.explode(_longs(F.lit(0).cast(long), F.ceil(F.col("k") / COPIES).cast(long))).alias("block"))
    first = F.col("block") * COPIES
    rows = cut(blocks.select("doc_id", "key", "n", F.explode(_longs(first, F.least(first + COPIES, "k"))).alias("copy")), "lengths")
    rest = rows.withColumn("n_tokens", F.col("n") % top).where("n_tokens > 0")
    groups = max(1, -(-rest.count() // group_rows))
    rest = rest.select("doc_id", "key", "copy", F.expr(f"n div {top}").alias("piece"), "n_tokens", F.pmod(F.xxhash64("doc_id", "key", "n", "copy"), F.lit(groups)).alias("__g"))
    schema = T.StructType(
        [rows.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("key", "copy", "piece", "n_tokens")), T.StructField("bin_id", T.StringType()), T.StructField("capacity", T.LongType()), T.StructField("offset", T.LongType())]
    )
    packed = rest.groupBy("__g").applyInPandas(_group(capacities), schema)
    # a null id is no id that is written like one
    name = F.concat_ws(".", F.coalesce(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.lit("n")), F.lower(F.hex("key")), F.hex("n"), "copy", "piece")
    full = (
        rows.where(F.col("n") >= top)
        .select("doc_id", "key", "n", "copy", F.explode(_longs(F.lit(0).cast(long), F.expr(f"n div {top}"))).alias("piece"))
        .select("doc_id", "key", "copy", "piece", F.lit(top).cast(long).alias("n_tokens"), name.alias("bin_id"), F.lit(top).cast(long).alias("capacity"), F.lit(0).cast(long).alias("offset"))
    )
    none = rows.where("n = 0").select(
        "doc_id", "key", "copy", F.lit(0).cast(long).alias("piece"), F.lit(0).cast(long).alias("n_tokens"), F.lit(None).cast("string").alias("bin_id"),
        F.lit(None).cast(long).alias("capacity"), F.lit(None).cast(long).alias("offset"),
    )
    return packed.unionByName(full).unionByName(none)


def _in_order(pieces: DataFrame, *more: str) -> DataFrame:
    return (
        pieces.where("bin_id is not null")
        .groupBy("bin_id", "capacity")
        .agg(F.sum("n_tokens").alias("used"), F.array_sort(F.collect_list(F.struct("offset", "doc_id", "key", "copy", "piece", "n_tokens", *more))).alias("pieces"))
        .withColumn("doc_ids", F.transform("pieces", lambda p: p["doc_id"]))
    )


def sequences(planned: DataFrame) -> DataFrame:
    """One row a bin: its capacity, fill and the pieces in order.  Pieces without a bin (documents
    with an empty or null text) end here: they hold nothing to train on and stand in no row."""
    return _in_order(planned)


def filled(docs: DataFrame, planned: DataFrame, capacities: tuple[int, ...] = CAPACITIES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``sequences`` with ``payload``, the bytes of each bin's pieces one after another.

    The plan must be that of the texts' bytes.  Each distinct (id, text) is read once and meets its pieces
    in one join, so a text moves once to them, and its bytes once more to their bins.
    """
    top = max(capacities)
    def owner(c: Column) -> Column:
        return F.coalesce(F.concat(F.lit("d"), c.cast("string")), F.lit("n"))

    texts = docs.select(owner(F.col(doc_id)).alias("i"), F.xxhash64(F.col(text)).alias("key"), F.encode(F.col(text), "UTF-8").alias("data"))
    texts = texts.groupBy("i", "key").agg(F.first("data").alias("data"))
    held = planned.where("bin_id is not null").withColumn("i", owner(F.col("doc_id"))).join(texts, ["i", "key"])
    part = F.substring(F.col("data"), (F.col("piece") * top + 1).cast("int"), F.lit(top))
    bins = _in_order(held.withColumn("part", part).drop("i", "data"), "part")
    return bins.withColumn("payload", F.aggregate("pieces", F.lit(b""), lambda a, p: F.concat(a, p["part"]))).withColumn("pieces", F.transform("pieces", lambda p: p.dropFields("part")))
