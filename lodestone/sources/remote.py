"""External vector stores: an interface, a Parquet-backed one, HTTP ones, and a Spark sink."""

from __future__ import annotations

import json
import math
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..constants import ATTRIBUTE_BYTES, UPSERT_BATCH, UPSERT_LARGE_BATCH
from ..functions import text, vectors
from ..operators.incremental import keep_first


class RemoteStore(Protocol):
    name: str
    batch: int

    def upsert(self, rows: list[dict]) -> None: ...

    def query(self, vector: list[float], k: int) -> list[dict]: ...

    def delete(self, ids: list[str]) -> None: ...

    def delete_namespace(self) -> None: ...


def rows_of(chunks: DataFrame) -> DataFrame:
    """Upload rows: id is the chunk's hash (first chunk of each), content fits an attribute."""
    out = chunks.select(
        F.col("hash").alias("id"), "path", "start_line", "end_line", text.truncate_ellipsis(F.col("text"), ATTRIBUTE_BYTES).alias("content"), "language",
        F.expr("cast(array() as array<string>)").alias("symbols"), F.col("vector").cast("array<float>").alias("vector"),
    )
    return keep_first(out, "id", "path")


def push(chunks: DataFrame, store: RemoteStore, reset: bool = False) -> None:
    """Upload from the executors, in batches of the store's size."""
    if reset:
        store.delete_namespace()

    def send(part: Iterator[Row]) -> None:
        held: list[dict] = []
        for row in part:
            held.append(row.asDict())
            if len(held) == store.batch:
                store.upsert(held)
                held = []
        if held:
            store.upsert(held)

    rows_of(chunks).foreachPartition(send)


def withdraw(chunks: DataFrame, store: RemoteStore) -> None:
    """Delete the rows of ``chunks`` by id, in batches of the store's size, from the executors."""

    def send(part: Iterator[Row]) -> None:
        held: list[str] = []
        for row in part:
            held.append(row["id"])
            if len(held) == store.batch:
                store.delete(held)
                held = []
        if held:
            store.delete(held)

    chunks.select(F.col("hash").alias("id")).distinct().foreachPartition(send)


@dataclass
class MemoryStore:
    """For tests on the driver: records each request."""

    name: str = "memory"
    batch: int = UPSERT_BATCH
    rows: dict = field(default_factory=dict)
    requests: list[int] = field(default_factory=list)

    def upsert(self, rows: list[dict]) -> None:
        for at in range(0, len(rows), self.batch):
            part = rows[at : at + self.batch]
            self.requests.append(len(part))
            self.rows.update({r["id"]: r for r in part})

    def query(self, vector: list[float], k: int) -> list[dict]:
        def score(r: dict) -> float:
            n = math.hypot(*vector) * math.hypot(*r["vector"])
            return sum(a * b for a, b in zip(vector, r["vector"], strict=True)) / n if n else 0.0

        return sorted(({**r, "score": score(r)} for r in self.rows.values()), key=lambda r: (-r["score"], r["id"]))[:k]

    def delete(self, ids: list[str]) -> None:
        for i in ids:
            self.rows.pop(i, None)

    def delete_namespace(self) -> None:
        self.rows.clear()


class ParquetStore:
    """A namespace as a Parquet folder: writes and queries run as Spark jobs."""

    name = "parquet"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, chunks: DataFrame, reset: bool = False) -> None:
        rows_of(chunks).write.mode("overwrite" if reset else "append").parquet(self.path)

    def query(self, vector: list[float], k: int) -> DataFrame:
        rows = self.spark.read.parquet(self.path)
        scored = rows.withColumn("score", vectors.cosine(F.col("vector"), vectors.literal(vector)))
        return scored.orderBy(F.round("score", 6).desc(), "id").limit(k).withColumnRenamed("content", "text")


Post = Callable[[str, dict, dict, float], dict]


def http(url: str, body: dict, headers: dict, timeout: float, method: str = "POST") -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers}, method=method)
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return json.loads(reply.read() or b"{}")


def with_retry(call: Callable[[], dict], attempts: int = 3, pause: float = 0.5) -> dict:
    """Repeat after failures with growing pauses; refused credentials are final."""
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except urllib.error.HTTPError as e:
            if e.code in (401, 403) or attempt == attempts:
                raise
        except OSError:
            if attempt == attempts:
                raise
        time.sleep(pause * attempt)
    raise AssertionError


@dataclass
class IndexApiStore:
    """A hosted index with ``/vectors/upsert``, ``/query`` and ``/vectors/delete`` routes."""

    endpoint: str
    api_key: str
    namespace: str
    timeout: float = 120.0
    name: str = "index-api"
    batch: int = UPSERT_BATCH
    post: Post = http

    def _call(self, route: str, body: dict) -> dict:
        return self.post(f"{self.endpoint.rstrip('/')}/{route}", {**body, "namespace": self.namespace}, {"Api-Key": self.api_key}, self.timeout)

    def upsert(self, rows: list[dict]) -> None:
        for at in range(0, len(rows), self.batch):
            part = [{"id": r["id"], "values": list(r["vector"]), "metadata": {k: r[k] for k in ("path", "start_line", "end_line", "content", "language")}} for r in rows[at : at + self.batch]]
            self._call("vectors/upsert", {"vectors": part})

    def query(self, vector: list[float], k: int) -> list[dict]:
        found = self._call("query", {"vector": vector, "topK": k or 50, "includeMetadata": True}).get("matches", [])
        return [{"id": m["id"], "score": m["score"], "symbols": [], **m.get("metadata", {})} for m in found]

    def delete(self, ids: list[str]) -> None:
        for at in range(0, len(ids), self.batch):
            self._call("vectors/delete", {"ids": ids[at : at + self.batch]})

    def delete_namespace(self) -> None:
        try:
            self._call("vectors/delete", {"deleteAll": True})
        except urllib.error.HTTPError as e:
            if e.code != 404:
                raise


@dataclass
class NamespaceApiStore:
    """A hosted store with one route per namespace; distances come back, scores go out."""

    base: str
    api_key: str
    namespace: str
    timeout: float = 120.0
    name: str = "namespace-api"
    batch: int = UPSERT_LARGE_BATCH
    pause: float = 0.5
    post: Post = http

    def _call(self, route: str, body: dict) -> dict:
        url = f"{self.base.rstrip('/')}/namespaces/{self.namespace}{route}"
        return with_retry(lambda: self.post(url, body, {"Authorization": f"Bearer {self.api_key}"}, self.timeout), pause=self.pause)

    def upsert(self, rows: list[dict]) -> None:
        unique = list({r["id"]: r for r in reversed(rows)}.values())[::-1]
        for at in range(0, len(unique), self.batch):
            self._call("", {"upsert_rows": [{**r, "vector": list(r["vector"])} for r in unique[at : at + self.batch]], "distance_metric": "cosine_distance"})

    def query(self, vector: list[float], k: int) -> list[dict]:
        found = self._call("/query", {"rank_by": ["vector", "ANN", vector], "top_k": k, "include_attributes": True}).get("rows", [])
        return [{**r, "score": 1.0 - r.get("$dist", 1.0)} for r in found]

    def delete(self, ids: list[str]) -> None:
        for at in range(0, len(ids), self.batch):
            self._call("", {"deletes": ids[at : at + self.batch]})

    def delete_namespace(self) -> None:
        try:
            self._call("/delete", {})
        except urllib.error.HTTPError as e:
            if e.code != 404:
                raise


def choose(config: dict, namespace: str) -> RemoteStore | None:
    """The named provider; else the first whose settings are complete; else none."""
    a, b, wanted = config.get("index_api", {}), config.get("namespace_api", {}), config.get("remote_provider")
    if wanted == "none":
        return None
    if wanted == "index_api" or (wanted is None and a.get("api_key") and a.get("endpoint")):
        if not (a.get("api_key") and a.get("endpoint")):
            raise ValueError("index_api needs api_key and endpoint")
        return IndexApiStore(a["endpoint"], a["api_key"], a.get("namespace") or namespace, a.get("timeout_secs", 120))
    if wanted == "namespace_api" or (wanted is None and b.get("api_key") and b.get("base")):
        if not (b.get("api_key") and b.get("base")):
            raise ValueError("namespace_api needs api_key and base")
        return NamespaceApiStore(b["base"], b["api_key"], f"{b.get('namespace_prefix', 'lodestone')}-{namespace}", b.get("timeout_secs", 120))
    return None
