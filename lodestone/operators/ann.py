"""Candidate generation for nearest neighbours."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import ANN_OVERSAMPLE, BINARY_OVERSAMPLE
from ..functions import vectors


def exact(df: DataFrame, query: Column, k: int, vector: str = "vector", key: str = "chunk_idx") -> DataFrame:
    return df.withColumn("semantic", vectors.cosine(F.col(vector), query)).orderBy(F.round("semantic", 6).desc(), key).limit(k)


def hamming_shortlist(df: DataFrame, query: Column, size: int, vector: str = "vector", key: str = "chunk_idx", bits: str | None = None) -> DataFrame:
    """The ``size`` rows whose sign bits are nearest; stored bits are used where given."""
    mine = F.col(bits) if bits else vectors.quantise(F.col(vector))
    return df.withColumn("distance", vectors.hamming(mine, vectors.quantise(query))).orderBy("distance", key).limit(size)


def two_phase(df: DataFrame, query: Column, k: int, vector: str = "vector", key: str = "chunk_idx", bits: str | None = None) -> DataFrame:
    """Sign-bit shortlist of ten times k, then exact cosine."""
    return exact(hamming_shortlist(df, query, BINARY_OVERSAMPLE * k, vector, key, bits), query, k, vector, key)


def oversampled(df: DataFrame, query: Column, limit: int, vector: str = "vector", key: str = "chunk_idx") -> DataFrame:
    """The candidates of the neighbour access path: exact, four times the limit."""
    return exact(df, query, ANN_OVERSAMPLE * limit, vector, key)


@dataclass
class Cells:
    """An inverted file: every vector lies in the cell of its nearest centre, and a query reads the nearest cells.

    The centres come from k-means over at most ``sample`` rows (a documented bound, chosen by a hash of the
    key); every row is then given its cell.  Centres are a few thousand numbers and go to the tasks;
    rows are stored sorted by cell, so that a query's cells are few row groups.
    """

    centres: np.ndarray
    probes: int

    @classmethod
    def fit(cls, df: DataFrame, cells: int | None = None, probes: int | None = None, sample: int = 50_000, vector: str = "vector", key: str = "chunk_idx", seed: int = 11) -> Cells:
        some = df.where(F.size(vector) > 0).select(F.xxhash64(key).alias("__o"), F.col(vector).alias("__v")).orderBy("__o").limit(sample)
        taken = some.select(array_to_vector(vectors.l2_normalise(F.col("__v"))).alias("features")).persist()
        n = taken.count()
        if not n:
            return cls(np.zeros((0, 0)), 0)
        k = min(n, cells or max(1, min(4096, round(n**0.5))))
        found = KMeans(k=k, seed=seed, maxIter=12).fit(taken) if k > 1 else None
        centres = np.array(found.clusterCenters()) if found else np.array([taken.first()["features"].toArray()])
        taken.unpersist()
        return cls(centres, min(len(centres), probes or max(1, -(-3 * len(centres) // 5))))

    def of(self, vector: Column) -> Column:
        """The nearest centre of each vector (null without one)."""
        centres = self.centres

        @F.pandas_udf("int")
        def nearest(rows: pd.Series) -> pd.Series:
            out = pd.Series([None] * len(rows), dtype="Int32")
            there = [i for i, v in enumerate(rows) if v is not None and len(v)]
            for at in range(0, len(there), 1024):
                part = there[at : at + 1024]
                m = np.stack([np.asarray(rows.iloc[i], np.float64) for i in part])
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                out.iloc[part] = ((centres**2).sum(axis=1) - 2 * m @ centres.T).argmin(axis=1)
            return out

        return nearest(vector)

    def assign(self, df: DataFrame, vector: str = "vector") -> DataFrame:
        """``df`` with ``cell``; no row is left out."""
        return df.withColumn("cell", self.of(F.col(vector)) if len(self.centres) else F.lit(None).cast("int"))

    def nearest(self, query: list[float]) -> list[int]:
        """The query's ``probes`` nearest cells."""
        if not len(self.centres):
            return []
        q = np.asarray(query, float)
        q = q / (np.linalg.norm(q) or 1)
        return [int(c) for c in ((self.centres - q) ** 2).sum(axis=1).argsort(kind="stable")[: self.probes]]

    def near(self, query: list[float]) -> Column:
        """The rows of the query's nearest cells; a filter that reaches the scan."""
        return F.col("cell").isin(self.nearest(query))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, [float(x) for x in c], self.probes) for i, c in enumerate(self.centres)]
        spark.createDataFrame(rows, "cell int, centre array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Cells:
        rows = spark.read.parquet(path).orderBy("cell").collect()
        return cls(np.array([r["centre"] for r in rows]), rows[0]["probes"]) if rows else cls(np.zeros((0, 0)), 0)


#: queries of one pass over the rows, scores and pairs held at once
QUERIES, SCORES, PAIRS = 8192, 1 << 20, 1 << 16
#: scores rank by millionths; a matrix product is nearer than the rest of this to the sum in order
UNIT, MARGIN = 1e6, 1.1e-6


def _cosines(q: np.ndarray, qn: np.ndarray, x: np.ndarray, xn: np.ndarray) -> np.ndarray:
    """``vectors.cosine`` along the last axis: the same sums in the same order."""
    dot = np.zeros(np.broadcast_shapes(qn.shape, xn.shape))
    with np.errstate(all="ignore"):
        for d in range(q.shape[-1]):
            dot += q[..., d] * x[..., d]
        n = qn * xn
        s = np.where(n == 0, 0.0, dot / n)
    return np.where(np.isnan(s), 1.0, np.clip(s, -1, 1))


def _norms(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    with np.errstate(all="ignore"):
        for d in range(x.shape[1]):
            out += x[:, d] * x[:, d]
    return np.sqrt(out)


def _units(s: np.ndarray) -> np.ndarray:
    """Millionths, halves away from zero as Spark rounds: by the decimal digits where they lie close to a half."""
    t = np.abs(s) * UNIT
    out = np.floor(t + 0.5)
    for i in np.flatnonzero(np.abs(t - np.floor(t) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(abs(s[i])))).scaleb(6).quantize(Decimal(1), ROUND_HALF_UP))
    return np.copysign(out, s).astype(np.int64)


def _unit(x: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit length, and those whose length is out of a product's reach (left zero)."""
    odd = ~((norms == 0) | ((norms > 1e-100) & (norms < 1e100)))
    plain = ~odd & (norms > 0)
    out = np.zeros_like(x)
    out[plain] = x[plain] / norms[plain, None]
    return out, np.flatnonzero(odd)


class _Best:
    """The ``k`` best rows of each query so far: most millionths, then least key."""

    def __init__(self, queries: int, k: int):
        self.k, self.rows, self.new = k, tuple(np.zeros(0, np.int64) for _ in range(3)), []
        self.least = np.full(queries, -np.inf)

    def add(self, *rows: np.ndarray) -> None:
        self.new.append(rows)
        if sum(len(x[0]) for x in self.new) >= SCORES:
            self.settle()

    def settle(self) -> None:
        q, u, key = (np.concatenate(x) for x in zip(self.rows, *self.new, strict=True))
        order = np.lexsort((key, -u, q))
        q, u, key = q[order], u[order], key[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        self.rows, self.new = tuple(x[place < self.k] for x in (q, u, key)), []
        last = place == self.k - 1
        self.least[q[last]] = u[last] / UNIT


def _search(queries: np.ndarray, probes: np.ndarray, k: int):
    """Over a task's rows (key, vector, cell): the best of all rows, and of those whose cell the query probes."""
    size = queries.shape[1]

    def rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column("vector")), size), False))
        flat = batch.column("vector").flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
        whole = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, size).any(axis=1)
        key = pc.fill_null(batch.column("key"), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        return key[whole], x[whole], pc.fill_null(batch.column("cell"), -1).to_numpy(zero_copy_only=False)[whole]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(len(queries), k), _Best(len(queries), k)]
        qn = _norms(queries)
        q, odd_q = _unit(queries, qn)
        for key, x, cell in map(rows, batches):
            n = len(key)
            if not n:
                continue
            xn = _norms(x)
            unit, odd_x = _unit(x, xn)
            step = max(1, SCORES // n)
            for at in range(0, len(q), step):
                block = np.arange(at, min(at + step, len(q)))
                s = q[block] @ unit.T
                if len(odd_x):
                    s[:, odd_x] = _cosines(queries[block, None], qn[block, None], x[None, odd_x], xn[None, odd_x])
                if len(rare := np.intersect1d(block, odd_q)):
                    s[rare - at] = _cosines(queries[rare, None], qn[rare, None], x[None], xn[None])
                floors = []
                for b, probed in zip(best, (False, True), strict=True):
                    least = b.least[block]
                    new = np.flatnonzero(np.isinf(least))
                    if len(new) and n > k:
                        own = np.where(probes[block[new]][:, cell], s[new], -np.inf) if probed else s[new]
                        least[new] = np.partition(own, n - k, axis=1)[:, n - k]
                    floors.append(least - MARGIN)
                few = np.isinf(floors[1])
                taken = s >= np.where(few, floors[0], np.minimum(*floors))[:, None]
                taken[few] |= probes[block[few]][:, cell]
                i, j = np.nonzero(taken)
                for a in range(0, len(i), PAIRS):
                    ii, jj = i[a : a + PAIRS], j[a : a + PAIRS]
                    mine = block[ii]
                    u = _units(_cosines(queries[mine], qn[mine], x[jj], xn[jj]))
                    for b, floor, there in zip(best, floors, (True, probes[mine, cell[jj]]), strict=True):
                        take = (s[ii, jj] >= floor[ii]) & there
                        b.add(mine[take], u[take], key[jj[take]])
            for b in best:
                b.settle()
        for b, probed in zip(best, (False, True), strict=True):
            q, u, key = map(pa.array, b.rows)
            yield pa.record_batch([q, pa.array(np.full(len(q), probed)), u, key], names=["query", "probed", "units", "key"])

    return run


def nearest(indexed: DataFrame, cells: Cells, queries: list[list[float]], k: int, vector: str = "vector", key: str = "chunk_idx") -> DataFrame:
    """(query, probed, units, key): what ``exact`` gives for each query, by its place in the list, in one pass for all.

    Once over all rows, and (``probed``) over the rows of the query's nearest cells; ``units`` are
    millionths of the cosine.  Each task keeps the ``k`` best of its rows, found by matrix products and
    ranked by sums in order.  Rows without a vector of the queries' length are nobody's neighbours; a null key counts as the least number.
    """
    asked = np.array(queries, np.float64)
    # one more column, never probed, for rows without a cell
    probes = np.zeros((len(asked), len(cells.centres) + 1), bool)
    for i, q in enumerate(asked):
        probes[i, cells.nearest(q)] = True
    rows = indexed.select(F.col(key).cast("bigint").alias("key"), F.col(vector).alias("vector"), F.col("cell").cast("int").alias("cell"))
    found = rows.mapInArrow(_search(asked, probes, k), "query bigint, probed boolean, units bigint, key bigint")
    place = F.row_number().over(Window.partitionBy("query", "probed").orderBy(F.desc("units"), "key"))
    return found.withColumn("place", place).where(F.col("place") <= k).drop("place")


def _blocks(queries: Iterable[list[float] | None]) -> Iterator[list[list[float]]]:
    """Lists of at most ``QUERIES`` queries of one length; those without a vector are left out, as nothing is near them."""
    waiting = defaultdict(list)
    for q in queries:
        if q and None not in q:
            waiting[len(q)].append(q)
            if len(waiting[len(q)]) == QUERIES:
                yield waiting.pop(len(q))
    yield from waiting.values()


def recall(indexed: DataFrame, cells: Cells, queries: Iterable[list[float] | None], k: int = 10) -> float:
    """The share of the exact ``k`` nearest rows that the cells give, over a stated list of queries."""
    hit = total = 0
    for block in _blocks(queries):
        both = nearest(indexed, cells, block, k).groupBy("query", "key").agg(F.min("probed").alias("missed"), F.max("probed").alias("got")).where("not missed")
        row = both.agg(F.count(F.lit(1)).alias("want"), F.count_if("got").alias("got")).first()
        hit, total = hit + row["got"], total + row["want"]
    return hit / total if total else 1.0
