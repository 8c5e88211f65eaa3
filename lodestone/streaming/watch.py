"""Change streams: notifications to debounced change sets to a fresh index."""

from __future__ import annotations

import json
import os
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from ..constants import DEBOUNCE_MS
from ..operators.incremental import categorise, last_event, sessions
from ..sources.repo import IGNORE_FILES, walk

EVENTS = "kind string, paths array<string>, ts timestamp"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Notification records (JSON lines) from a folder as a stream."""
    reader = spark.readStream.schema(EVENTS)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).json(folder)


class TreeChanges(DataSource):
    """``spark.readStream.format("tree_changes")``: create, modify and remove records of a source tree.

    Each read lists the tree and compares with the listing before; listings are numbered files in the
    ``state`` folder and the number is the offset, so that a batch is replayed from the same two.
    The first listing is taken when the stream first starts.
    """

    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return EVENTS

    def simpleStreamReader(self, schema):
        return TreeReader(self.options["path"], self.options["state"], self.options.get("ignore_file", ""))


class TreeReader(SimpleDataSourceStreamReader):
    def __init__(self, root: str, state: str, ignore_file: str):
        self.root, self.state = root, state
        self.names = (*IGNORE_FILES, *([ignore_file] if ignore_file else []))

    def _list(self) -> dict[str, list]:
        out = {}
        for entry in sorted(os.listdir(self.root)):
            for rel in walk(self.root, entry, self.names):
                try:
                    info = os.stat(os.path.join(self.root, rel))
                except OSError:
                    continue
                out[rel] = [info.st_mtime_ns, info.st_size]
        return out

    def _path(self, n: int) -> str:
        return os.path.join(self.state, f"{n:012d}.json")

    def _load(self, n: int) -> dict:
        with open(self._path(n), encoding="utf-8") as f:
            return json.load(f)

    def _save(self, n: int) -> None:
        os.makedirs(self.state, exist_ok=True)
        with open(self._path(n) + ".new", "w", encoding="utf-8") as f:
            json.dump({"at": time.time(), "files": self._list()}, f)
        os.replace(self._path(n) + ".new", self._path(n))

    def initialOffset(self) -> dict:
        if not os.path.exists(self._path(0)):
            self._save(0)
        return {"n": 0}

    def _between(self, a: int, b: int) -> list[tuple]:
        old, now = self._load(a)["files"], self._load(b)
        at, new = datetime.fromtimestamp(now["at"], UTC), now["files"]
        kinds = [("remove", p) for p in old if p not in new] + [("modify" if p in old else "create", p) for p in new if old.get(p) != new[p]]
        return [(kind, [p], at) for kind, p in sorted(kinds, key=lambda x: x[1])]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        n = start["n"]
        self._save(n + 1)
        rows = self._between(n, n + 1)
        return iter(rows), {"n": n + 1 if rows else n}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([r for n in range(start["n"], end["n"]) for r in self._between(n, n + 1)])

    def commit(self, end: dict) -> None:
        for name in os.listdir(self.state):
            if name.endswith(".json") and int(name[:-5]) < end["n"] - 1:
                os.remove(os.path.join(self.state, name))


def read_tree(spark: SparkSession, root: str, state: str, ignore_file: str = "") -> DataFrame:
    """The changes of a source tree as a stream of notifications."""
    spark.dataSource.register(TreeChanges)
    return spark.readStream.format("tree_changes").option("path", root).option("state", state).option("ignore_file", ignore_file).load()


def debounced(events: DataFrame, gap_ms: int = DEBOUNCE_MS, lateness: str = "10 seconds") -> DataFrame:
    """Bursts of changes in event time, each with its touched and deleted paths.

    One global key by design: a burst is a fact about the whole tree, and its
    state is one session with a set of paths.
    """
    return sessions(categorise(events).withWatermark("ts", lateness), gap=f"{gap_ms} milliseconds")


def changes_of(batch: DataFrame) -> DataFrame:
    """(path, op): the last event of each path in a micro-batch decides."""
    return last_event(categorise(batch)).select("path", "op")


def run(events: DataFrame, apply: Callable[[DataFrame], object], checkpoint: str, trigger_ms: int = DEBOUNCE_MS, once: bool = False) -> StreamingQuery:
    """Apply each micro-batch's changes in turn; the trigger interval gathers bursts.

    Micro-batches run one after another, so a slow build holds back the next and
    events gather meanwhile.  A batch that is replayed after a failure applies the
    same final state again.
    """
    triggered = 0

    def each(batch: DataFrame, batch_id: int) -> None:
        nonlocal triggered
        held = batch.persist()
        try:
            if not held.isEmpty():
                triggered += 1
                apply(changes_of(held))
        finally:
            held.unpersist()

    writer = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{trigger_ms} milliseconds")
    return writer.start()


def settled(stream: DataFrame) -> DataFrame:
    """Run an append-mode stream over all that is there now, and read what it wrote."""
    spark = stream.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/lodestone-streams"
    folder = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def stop(query: StreamingQuery, wait_s: float = 60.0) -> None:
    """End after the batch in flight."""
    if query.status["isTriggerActive"]:
        threading.Event().wait(0.1)
        query.processAllAvailable()
    query.stop()
    query.awaitTermination(int(wait_s))


def stateful_counts(events: DataFrame) -> DataFrame:
    """Events and triggers so far for each kind, kept in state across batches."""
    return events.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest"))
