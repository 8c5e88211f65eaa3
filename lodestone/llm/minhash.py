"""Near-duplicates: one-permutation hashing with optimal densification, banded
buckets and star-shaped candidate edges.

Each document's shingle set is hashed once; the least hash in each of K bins is
its signature, and an empty bin copies the first non-empty one in a fixed random
order of its own.  Bands of the signature are bucket keys.  Documents with equal
sets first fall into one class.  In each bucket one centre, the member with the
most collisions, is compared with every other member; the full sets confirm a
link.  That gives as many pairs as members, not their square.

A star loses links only between two members that are not yet connected.  Documents
of buckets that still span several components are therefore joined once more, by an
exact prefix filter: with shingles in order of rarity, two sets of 80 % share one among the
first ninth of the shorter and the first fifth of the longer, and its places bound their
overlap.  Of each shingle's documents those of the commonest component meet only the others,
never one another, and the documents of a frequent shingle are salted over many tasks.
No bucket is capped.

Sets, links and components belong to the distinct sets (classes); ids come in only at the
end, so that an id with several texts keeps the links of each.

Defined results: a null or empty text has no shingles and is linked with nothing; a row
without id is linked by its text like any other, and takes the least id of its component
(null where none has one, and kept then); all texts of one id share a component, as the id
names one document; very long texts are read whole; an empty table gives an empty result;
other columns are ignored.  ``keep_first`` judges rows, not ids: of each group of linked texts the
row of least id (rows without id last) and then least text hash stays, of equal rows one; a
text of a repeated id goes only if it is itself a duplicate; rows without words all stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrowtext as at
from .common import cut, discard, fresh, release
from .components import components

#: at similarity 0.8 a pair shares none of 40 bands of 5 with probability 1.2e-7
BANDS, ROWS = 40, 5
BINS = BANDS * ROWS
U = np.uint64
_CODES = at.byte_codes(fold=True)
_ORDER = np.argsort(np.random.default_rng(20240229).random((BINS, BINS)), axis=1)
_MULT = at.mix(np.arange(11, 11 + 64, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Each row's sorted distinct 64-bit shingle hashes."""
    starts, ends, first = at.words(data, offsets)
    h = at.word_hashes(data, starts, ends, _CODES)
    n = len(h)
    if n >= width:
        runs = np.zeros(n - width + 1, U)
        for k in range(width):
            runs += h[k : n - width + 1 + k] * _MULT[k]
        runs = at.mix(runs)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        elif b > a:
            out.append(at.mix((h[a:b] * _MULT[width : width + b - a]).sum(keepdims=True) + U(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """The densified one-permutation signature of a non-empty sorted set."""
    bins = ((s >> U(32)) * U(BINS)) >> U(32)
    lead = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    sig = np.zeros(BINS, U)
    full = np.zeros(BINS, bool)
    where = bins[lead].astype(np.int64)
    sig[where] = s[lead]
    full[where] = True
    gaps = np.flatnonzero(~full)
    if len(gaps):
        order = _ORDER[gaps]
        sig[gaps] = sig[order[np.arange(len(gaps)), full[order].argmax(axis=1)]]
    return sig


def bands(s: np.ndarray) -> np.ndarray:
    rows = signature(s).reshape(BANDS, ROWS)
    key = (rows * _MULT[10 : 10 + ROWS]).sum(axis=1, dtype=U) + np.arange(BANDS, dtype=U) * _MULT[20]
    return at.mix(key).view(np.int64)


#: heads of one shingle that meet in one salt
MEET = 2048


def _keys(sets: list[np.ndarray]) -> list[pa.Array]:
    """Two 64-bit hashes of each set."""
    sums = [at.mix(s + _MULT[30]).sum(dtype=U) for s in sets], [at.mix(s ^ _MULT[31]).sum(dtype=U) for s in sets]
    return [pa.array(np.array(k, U).view(np.int64)) for k in sums]


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in at.slices(batches):
            sets = shingles(data, offsets, width)
            yield pa.record_batch(
                [
                    rows.column("doc_id"), rows.column("th"), pa.array([len(s) for s in sets], pa.int64()), *_keys(sets),
                    at.list_column([bands(s) if len(s) else np.zeros(0, np.int64) for s in sets], pa.int64()),
                ],
                names=["doc_id", "th", "n", "k1", "k2", "bands"],
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in at.slices(batches):
            sets = shingles(data, offsets, width)
            yield pa.record_batch([*_keys(sets), at.list_column([s.view(np.int64) for s in sets], pa.int64())], names=["k1", "k2", "items"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (c, m) whose full sets are alike enough."""
    left = pairs.join(sets.select(F.col("cls").alias("m"), F.col("items").alias("ms")), "m")
    both = left.join(sets.select(F.col("cls").alias("c"), F.col("items").alias("cs")), "c")
    inter = F.size(F.array_intersect("ms", "cs"))
    return (
        both.withColumn("inter", inter)
        .where(100 * F.col("inter") >= percent * (F.size("ms") + F.size("cs") - F.col("inter")))
        .select(F.col("c").alias("a"), F.col("m").alias("b"))
    )


def _cross(docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (c, m) of ``docs(cls, n, own)`` with different ``own`` whose sets may be alike enough: none is missed."""
    items = docs.join(sets, "cls").select("cls", "own", "n", F.explode("items").alias("item"))
    rarity = items.groupBy("item").agg(F.count(F.lit(1)).alias("df"), F.min("own").alias("lo"), F.max("own").alias("hi"))
    # the order needs every shingle's count, the join only those of several components
    ordered = items.join(rarity, "item").groupBy("cls", "own", "n").agg(F.array_sort(F.collect_list(F.struct("df", "item", (F.col("lo") < F.col("hi")).alias("several")))).alias("o"))
    reach = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    heads = (
        ordered.select("cls", "own", "n", F.posexplode(F.slice("o", F.lit(1), reach.cast("int"))).alias("at", "x"))
        .where("x.several")
        .select("cls", "own", "n", "at", "x.item", ((100 + percent) * (F.col("n") - F.col("at")) >= 2 * percent * F.col("n")).alias("short"))
    )
    heads = cut(heads, "prefixes")
    per_own = heads.groupBy("item", "own").agg(F.count(F.lit(1)).alias("size"))
    held = per_own.groupBy("item").agg(F.sum("size").alias("size"), F.max(F.struct("size", "own"))["own"].alias("chief")).where("size > 1")
    heads = cut(heads.join(held.withColumn("salts", F.ceil(F.col("size") / MEET).cast("int")), "item").drop("size"), "heads")
    near = (
        (F.col("a_own") != F.col("b_own"))
        & ((F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_cls") < F.col("b_cls"))))
        & (100 * F.col("a_n") >= percent * F.col("b_n"))
        & ((100 + percent) * F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at")) >= percent * (F.col("a_n") + F.col("b_n")))
    )
    one = heads.where("short").withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int"))
    all_ = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    found = None
    for a, b in ((one, all_.where("own <> chief")), (one.where("own <> chief"), all_.where("own = chief"))):
        a, b = (side.select("item", "salt", *[F.col(c).alias(f"{name}_{c}") for c in ("cls", "own", "n", "at")]) for side, name in ((a, "a"), (b, "b")))
        part = a.join(b, ["item", "salt"]).where(near).select(F.col("a_cls").alias("c"), F.col("b_cls").alias("m"))
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def _labelled(docs: DataFrame, width: int, percent: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): doc_id, th, n, k1, k2 of each row; k1, k2, n, rep and label of each distinct set.

    Classes with one label are linked; ``th`` is the text's hash.
    """
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("th", F.xxhash64("text"))
    i64 = T.LongType()
    key = [T.StructField("k1", i64), T.StructField("k2", i64)]
    schema = T.StructType([src.schema["doc_id"], T.StructField("th", i64), T.StructField("n", i64), *key, T.StructField("bands", T.ArrayType(i64))])
    signed = cut(src.mapInArrow(_sign(width), schema), "signatures")
    real = signed.where("n > 0")
    # equal sets have equal bands; the row of least id gives the set of its class
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    classes = real.groupBy("k1", "k2", "n").agg(F.min(order).alias("first"), F.max_by("bands", F.col("th")).alias("bands")).select("k1", "k2", "n", F.col("first.doc_id").alias("rep"), "first.th", "bands")
    classes = cut(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")

    hits = classes.select("cls", "n", F.explode("bands").alias("band"))
    shared = hits.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = cut(hits.join(shared, "band"), "buckets")
    score = buckets.groupBy("cls").agg(F.sum("size").alias("score"))
    members = cut(buckets.drop("size").join(score, "cls"), "members")
    discard(buckets)

    wanted = members.select("cls").distinct().join(classes.select("cls", "k1", "k2", "rep", F.col("th").alias("first")), "cls")
    of_text = src.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("th") == F.col("first")), "left_semi").select("text").mapInArrow(_sets(width), T.StructType([*key, T.StructField("items", T.ArrayType(i64))]))
    sets = cut(of_text.groupBy("k1", "k2").agg(F.first("items").alias("items")).join(wanted.select("k1", "k2", "cls"), ["k1", "k2"]).select("cls", "items"), "sets")

    best = F.max_by("cls", F.struct("score", -F.col("cls")))
    centres = members.groupBy("band").agg(best.alias("c")).join(classes.select(F.col("cls").alias("c"), F.col("n").alias("cn")), "c")
    close = (F.col("c") != F.col("cls")) & (100 * F.least("n", "cn") >= percent * F.greatest("n", "cn"))
    stars = members.join(centres, "band").where(close).select("c", F.col("cls").alias("m")).distinct()
    label = cut(components(_verified(stars, sets, percent)), "labels")
    release(docs.sparkSession)

    owned = members.join(label.select(F.col("node").alias("cls"), "label"), "cls", "left").select("band", "cls", "n", F.coalesce("label", "cls").alias("own"))
    split = owned.groupBy("band").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo <> hi").select("band")
    loose = cut(owned.join(split, "band").select("cls", "n", "own").distinct(), "open")
    late = _verified(_cross(loose, sets, percent), sets, percent)
    own = loose.select("cls", "own")
    late = late.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    # of the components' own graph, which is small
    merged = components(late)
    labels = (
        classes.select("k1", "k2", "n", "rep", "cls")
        .join(label.select(F.col("node").alias("cls"), "label"), "cls", "left")
        .withColumn("label", F.coalesce("label", "cls"))
        .join(merged.select(F.col("node").alias("label"), F.col("label").alias("further")), "label", "left")
        .select("k1", "k2", "n", "rep", F.coalesce("further", "label").alias("label"))
    )
    labels = cut(labels, "class-labels")
    discard(members, sets, loose, label, classes)
    release(docs.sparkSession)
    return signed, labels


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``."""
    signed, labels = _labelled(docs, width, percent, doc_id, text)
    # an id with several texts joins their components
    real = signed.where("n > 0")
    several = real.where("doc_id is not null").groupBy("doc_id").agg(*[f(k).alias(f"{side}{k}") for k in ("k1", "k2") for side, f in (("lo", F.min), ("hi", F.max))])
    several = several.where("lok1 <> hik1 or lok2 <> hik2").select("doc_id")
    rows = cut(real.join(several, "doc_id").join(labels, ["k1", "k2", "n"]).select("doc_id", "label").distinct(), "shared-ids")
    joined = components(rows.join(rows.groupBy("doc_id").agg(F.min("label").alias("b")), "doc_id").select(F.col("label").alias("a"), "b"))
    names = labels.join(joined.select(F.col("node").alias("label"), F.col("label").alias("whole")), "label", "left").withColumn("whole", F.coalesce("whole", "label"))
    least = names.groupBy("whole").agg(F.min("rep").alias("class"))
    names = cut(names.join(least, "whole").select("k1", "k2", "n", "class"), "names")
    out = real.select("doc_id", "n", "k1", "k2").join(names, ["k1", "k2", "n"]).select("doc_id", "n", "class")
    rest = signed.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("class"))
    discard(labels)
    return out.unionByName(rest).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("class").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.col("class")).alias("kept"),
    )


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` but for those that repeat an earlier one: see the defined results."""
    names = docs.columns
    signed, labels = _labelled(docs, width, percent, doc_id, text)
    rows = signed.where("n > 0").join(labels.drop("rep"), ["k1", "k2", "n"]).groupBy("label", "doc_id", "th").agg(F.count(F.lit(1)).alias("copies"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    groups = cut(rows, "texts")
    first = groups.groupBy("label").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("all")).where("all > 1")
    marked = groups.join(first, "label").select("doc_id", "th", "copies", (order == F.col("first")).alias("stays"))
    marked = marked.where("not stays or copies > 1").select("doc_id", "th", "stays")
    i, h, keep = (fresh(n, *names) for n in ("__id", "__th", "__stays"))
    marked = cut(marked.toDF(i, h, keep), "repeats")
    discard(signed, labels, groups)
    same = F.col(doc_id).eqNullSafe(F.col(i)) & F.xxhash64(F.col(text)).eqNullSafe(F.col(h))
    once = docs.join(marked, same, "left_anti")
    # equal in id and text: the row whose other columns read least
    whole = F.struct(*[F.col(f"`{c}`") for c in names])
    many = docs.join(marked.where(F.col(keep)), same).groupBy(i, h).agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*")
    return once.unionByName(many)
