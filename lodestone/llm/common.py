"""Shared helpers: reading tables, cutting lineage, span expressions."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; where none is named on one machine (tests),
    a folder of this process, removed when it ends.  A cluster without one is an error:
    a local folder there would hold a part of each table on every machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "own" not in _OWN:
        _OWN["own"] = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, _OWN["own"], ignore_errors=True)
    return f"file://{_OWN['own']}"


def cut(df: DataFrame, name: str = "cut", keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: the lineage ends at files
    that outlive any executor.  They go when the driver ends, unless ``keep`` is set."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not keep:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove the files of results of ``cut`` that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the driver collect what finished plans hold: only then does Spark remove their shuffle files and
    broadcast blocks, which a driver with little garbage of its own would keep for long."""
    spark._jvm.System.gc()


def fresh(name: str, *taken: str) -> str:
    """A column name that starts like ``name`` and that none of ``taken`` has (in any case)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, op: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """``op`` from 0 on over the values before each place, and last over all: size + 1 bigints.

    Two levels: prefixes within blocks, then those of the blocks' totals, so that no array
    longer than a block, or than the list of blocks, is grown step by step.
    """
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))

    def fold(items: Column, value: Callable[[Column], Column]) -> Column:
        return F.aggregate(items, start, lambda a, v: F.struct(op(a["at"], value(v)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    def of(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / block).cast("int")), lambda i: F.slice(v, i * block + 1, F.lit(block)))
        return let(F.transform(blocks, lambda b: fold(b, lambda x: x)), joined)

    def joined(parts: Column) -> Column:
        return let(fold(parts, lambda p: p["at"]), lambda base: F.concat(
            F.flatten(F.zip_with(parts, base["out"], lambda p, b: F.transform(p["out"], lambda x: op(b, x)))), F.array(base["at"])
        ))

    return let(values, of)


def matches(text: Column, pattern: str, kind: str, order: int, group: int = 0) -> Column:
    """All leftmost non-overlapping matches of ``pattern`` as an array of
    struct(start, k, end, kind, value); offsets are code points, end exclusive.

    The text between matches comes from the same pattern, so that running sums
    of both lengths give the offsets, in time in proportion to text and matches.
    ``value`` is the given regex group.
    """
    rx = F.lit(pattern)
    empty = F.expr("cast(array() as array<struct<start:bigint,k:int,end:bigint,kind:string,value:string>>)")
    hits = F.regexp_extract_all(text, rx, F.lit(0))
    values = hits if group == 0 else F.regexp_extract_all(text, rx, F.lit(group))
    steps = F.zip_with(
        F.split(text, pattern, -1), hits,
        lambda g, h: F.struct(F.length(g).cast("bigint").alias("g"), F.coalesce(F.length(h), F.lit(0)).cast("bigint").alias("h")),
    )

    def found(m: Column) -> Column:
        return let(running(F.transform(m["steps"], lambda s: s["g"] + s["h"]), lambda a, b: a + b), lambda before: F.transform(
            m["values"],
            lambda v, i: F.struct(
                (before[i] + m["steps"][i]["g"]).alias("start"),
                F.lit(order).alias("k"),
                (before[i] + m["steps"][i]["g"] + m["steps"][i]["h"]).alias("end"),
                F.lit(kind).alias("kind"),
                v.alias("value"),
            ),
        ))

    return F.when(F.regexp_like(text, rx), let(F.struct(values.alias("values"), steps.alias("steps")), found)).otherwise(empty)


#: characters of one part of a text, a power of two
PART = 4096


def parts(text: Column) -> Column:
    """The text in parts of ``PART`` characters, so that a place is found without a walk from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))


def piece(of: Column, a: Column, b: Column) -> Column:
    """The characters ``a`` up to ``b`` of a text given by its ``parts``."""
    bits = PART.bit_length() - 1
    first, last = F.shiftright(a, bits).cast("int"), F.shiftright(b - 1, bits).cast("int")
    head = F.substring(of[first], (a.bitwiseAND(F.lit(PART - 1)) + 1).cast("int"), F.least(b - a, F.lit(PART)).cast("int"))
    rest = F.concat(head, F.array_join(F.slice(of, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.left(of[last], (b - last * PART).cast("int")))
    return F.when(b <= a, F.lit("")).when(first == last, head).otherwise(rest)


def without(text: Column, ranges: Column, mark: str = "") -> Column:
    """``text`` with each of ``ranges`` (start, end; sorted) replaced by ``mark``, overlapping ones by one."""

    def done(m: Column) -> Column:
        kept = F.transform(m["r"], lambda s, i: F.when(s["start"] >= m["reach"][i], F.concat(piece(m["of"], m["reach"][i], s["start"].cast("bigint")), F.lit(mark))).otherwise(F.lit("")))
        return F.concat(F.array_join(kept, ""), piece(m["of"], m["reach"][F.size(m["r"])], F.length(text).cast("bigint")))

    reach = running(F.transform(ranges, lambda s: s["end"].cast("bigint")), lambda a, b: F.greatest(a, b))
    return let(F.struct(parts(text).alias("of"), ranges.alias("r"), reach.alias("reach")), done)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the array."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def bounded(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_bytes: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(o, y, text) of at most ``max_rows`` labelled rows with at most ``max_bytes`` of text, those of least
    hash ``o`` of the id, and the scratch table to discard when they have been read."""
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    sample = marked.select(F.col("doc_id").alias("id"), "y", F.xxhash64("doc_id").alias("o")).orderBy("o", "id").limit(max_rows)
    own = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(sample), "id")
    pool = cut(own.groupBy("id", "y", "o").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "training")
    left, taken = max_bytes, []
    for row in pool.select("id", "o", F.octet_length("text").alias("n")).orderBy("o", "id").toLocalIterator():
        if row["n"] <= left:
            left -= row["n"]
            taken.append((row["id"],))
    chosen = docs.sparkSession.createDataFrame(taken, pool.select("id").schema)
    return pool.join(F.broadcast(chosen), "id").select("o", "y", "text"), pool
