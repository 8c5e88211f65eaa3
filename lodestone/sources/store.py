"""Snapshots: the index's tables as Parquet, versioned, with one pointer to the live one.

    <root>/snap=<id>/{chunks,postings,corpus,symbols,edges,imports,files,directories,cells,metadata}
    <root>/snap=<id>/MANIFEST   where each bucket of the bucketed tables lies
    <root>/CURRENT      the id of the live snapshot
    <root>/BUILDING     who builds, while a build runs

A snapshot is written in full before the pointer moves, so readers see the old or
the new one.  Chunks, postings and files are kept in buckets by path: an update writes the
buckets it touches, and the new manifest names the old snapshots' files for the others.
All access goes through Hadoop's file system, so the root may be on
any store that Spark reads.
"""

from __future__ import annotations

import json
import os
import socket
import time
import uuid
from collections.abc import Iterable
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import FORMAT_VERSION
from ..operators.ann import Cells
from ..operators.graph import Graph
from .. import schemas

GRAPH_TABLES = ("symbols", "edges", "imports")
#: tables in buckets by path; the number of buckets is part of the format
BUCKETED = ("chunks", "postings", "files")
BUCKETS = 64


def bucket_of(path: Column) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


class _Files:
    """The few file operations that the store needs, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark._jvm
        self.path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{root}/{p}" if p else root)
        conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(conf)
        self.context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        self.replace = spark.sparkContext._gateway.new_array(rename, 1)
        self.replace[0] = rename.OVERWRITE

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def read(self, p: str) -> str | None:
        if not self.exists(p):
            return None
        stream = self.fs.open(self.path(p))
        try:
            return bytes(b & 255 for b in stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, p: str, text: str, overwrite: bool = True) -> None:
        """By way of a temporary name and a rename; without ``overwrite``, creation is exclusive."""
        if not overwrite:
            out = self.fs.create(self.path(p), False)
            out.write(bytearray(text.encode()))
            out.close()
            return
        tmp = f"{p}.{uuid.uuid4().hex}"
        out = self.fs.create(self.path(tmp), True)
        out.write(bytearray(text.encode()))
        out.close()
        # one step that replaces: a reader, or a crash, in between sees the old file or the new one
        self.context.rename(self.path(tmp), self.path(p), self.replace)

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)

    def folders(self, p: str = "") -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(p)) if s.isDirectory()] if self.exists(p) else []


@dataclass
class Snapshot:
    spark: SparkSession
    root: str
    snap: str

    @cached_property
    def manifest(self) -> dict:
        """table -> schema and, for each bucket with rows, the snapshot whose folder holds it."""
        return json.loads(_Files(self.spark, self.root).read(f"snap={self.snap}/MANIFEST") or "{}")

    def table(self, name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table, or the given buckets of a bucketed one."""
        entry = self.manifest.get(name)
        if entry is None:
            return self.spark.read.parquet(f"{self.root}/snap={self.snap}/{name}")
        schema, wanted = T.StructType.fromJson(entry["schema"]), None if buckets is None else set(buckets)
        paths = [f"{self.root}/snap={owner}/{name}/bucket={b}" for b, owner in entry["owner"].items() if wanted is None or int(b) in wanted]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @property
    def metadata(self) -> dict:
        return self.table("metadata").first().asDict()

    def verify(self) -> None:
        """Raise unless every chunk that the metadata counts is there, with a vector of its dimension."""
        meta = self.metadata
        wrong = F.sum((F.coalesce(F.size("vector"), F.lit(-1)) != meta["vector_dim"]).cast("bigint"))
        held = self.table("chunks").agg(F.count(F.lit(1)).alias("n"), F.coalesce(wrong, F.lit(0)).alias("wrong")).first()
        if held["n"] != meta["total_chunks"] or held["wrong"]:
            raise ValueError(f"the index holds {held['n']} of {meta['total_chunks']} chunks, {held['wrong']} of them without a vector of {meta['vector_dim']}")

    @property
    def cells(self) -> Cells | None:
        """The neighbour index; None where the snapshot has none, or one that does not fit its vectors."""
        if not _Files(self.spark, self.root).exists(f"snap={self.snap}/cells"):
            return None
        found = Cells.load(self.spark, f"{self.root}/snap={self.snap}/cells")
        fits = found.centres.ndim == 2 and found.centres.shape[1] == self.metadata["vector_dim"] and "cell" in self.table("chunks").columns
        return found if fits else None

    @property
    def graph(self) -> Graph:
        return Graph(*(self.table(t) for t in GRAPH_TABLES))


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), _Files(spark, root.rstrip("/"))

    def current(self) -> Snapshot | None:
        """The live snapshot; None without one or with one of another format."""
        snap = self.files.read("CURRENT")
        if snap is None:
            return None
        found = Snapshot(self.spark, self.root, snap.strip())
        return found if found.metadata["version"] == FORMAT_VERSION else None

    def save(
        self, tables: dict[str, DataFrame], repo_path: str, vector_dim: int, embedding_model: str, total_files: int | None = None, cells: Cells | None = None,
        base: Snapshot | None = None, touched: Iterable[int] = (),
    ) -> Snapshot:
        """Write a snapshot.  Bucketed tables have a column ``bucket``; with a ``base`` they replace its ``touched``
        buckets and the others stay where they are.  Without ``total_files`` the rows of ``files`` are counted."""
        snap, manifest = uuid.uuid4().hex, {}
        if cells is not None:
            cells.save(self.spark, f"{self.root}/snap={snap}/cells")
        for name, df in tables.items():
            path = f"{self.root}/snap={snap}/{name}"
            if name not in BUCKETED:
                df.write.option("compression", "zstd").parquet(path)
                continue
            # a query's terms, and the cells of its neighbours, then sit in few row groups
            order = {"postings": ["bucket", "term"], "chunks": ["bucket", *(["cell"] if "cell" in df.columns else []), "chunk_idx"]}.get(name, ["bucket", "path"])
            df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("compression", "zstd").partitionBy("bucket").parquet(path)
            gone = set(touched)
            owner = {} if base is None else {b: o for b, o in base.manifest[name]["owner"].items() if int(b) not in gone}
            owner |= {f.removeprefix("bucket="): snap for f in self.files.folders(f"snap={snap}/{name}") if f.startswith("bucket=")}
            manifest[name] = {"schema": df.drop("bucket").schema.jsonValue(), "owner": owner}
        self.files.write(f"snap={snap}/MANIFEST", json.dumps(manifest))
        found = Snapshot(self.spark, self.root, snap)
        n = found.table("chunks").count()
        total_files = found.table("files").count() if total_files is None else total_files
        meta = self.spark.range(1).select(
            F.lit(FORMAT_VERSION).alias("version"), F.lit(repo_path).alias("repo_path"), F.sha2(F.lit(repo_path), 256).alias("repo_hash"), F.lit(vector_dim).alias("vector_dim"),
            F.current_timestamp().alias("indexed_at"), F.lit(total_files).cast("long").alias("total_files"), F.lit(n).cast("long").alias("total_chunks"), F.lit(embedding_model).alias("embedding_model"),
        )
        meta.to(schemas.METADATA).write.parquet(f"{self.root}/snap={snap}/metadata")
        self.files.write("CURRENT", snap)
        return found

    def prune(self, keep: int = 1) -> None:
        """Delete snapshots other than the live one and the ``keep - 1`` latest, and of those whose buckets these still
        use, all that they do not."""
        live = (self.files.read("CURRENT") or "").strip()
        old = [f for f in self.files.folders() if f.startswith("snap=") and f != f"snap={live}"]
        old.sort(key=lambda f: self.files.fs.getFileStatus(self.files.path(f)).getModificationTime())
        drop = old[: max(0, len(old) - (keep - 1))]
        kept = [live, *(f.removeprefix("snap=") for f in old if f not in drop)]
        used = {f"snap={o}/{name}/bucket={b}" for k in kept for name, e in Snapshot(self.spark, self.root, k).manifest.items() for b, o in e["owner"].items()}
        for f in drop:
            if not any(u.startswith(f + "/") for u in used):
                self.files.delete(f)
                continue
            for name in self.files.folders(f):
                for part in self.files.folders(f"{f}/{name}"):
                    if part.startswith("bucket=") and f"{f}/{name}/{part}" not in used:
                        self.files.delete(f"{f}/{name}/{part}")
                if name not in BUCKETED:
                    self.files.delete(f"{f}/{name}")

    def clone_from(self, other: Store) -> bool:
        """Start from another checkout's live snapshot where this store has none."""
        source = other.current()
        if source is None or self.current() is not None:
            return False
        jvm = self.spark._jvm
        for snap in {source.snap, *(o for e in source.manifest.values() for o in e["owner"].values())}:
            name = f"snap={snap}"
            jvm.org.apache.hadoop.fs.FileUtil.copy(other.files.fs, other.files.path(name), self.files.fs, self.files.path(name), False, self.spark._jsc.hadoopConfiguration())
        self.files.write("CURRENT", source.snap)
        return True

    # --- build state -------------------------------------------------------

    @contextmanager
    def building(self):
        """Marks a running build; fails if another one is alive."""
        if self.build_state() == "building":
            raise RuntimeError("another build is running")
        self.files.delete("BUILDING")
        self.files.write("BUILDING", json.dumps({"pid": os.getpid(), "host": socket.gethostname(), "started_at": time.time(), "version": FORMAT_VERSION}), overwrite=False)
        try:
            yield
        finally:
            self.files.delete("BUILDING")

    def build_state(self) -> str:
        """building, interrupted, ready, partial or missing."""
        marker = self.files.read("BUILDING")
        if marker is not None:
            try:
                owner = json.loads(marker)
            except ValueError:
                return "interrupted"
            return "building" if owner.get("host") != socket.gethostname() or _alive(owner.get("pid", -1)) else "interrupted"
        if self.files.read("CURRENT") is not None:
            return "ready"
        return "partial" if any(f.startswith("snap=") for f in self.files.folders()) else "missing"

    def stats(self) -> dict:
        found = self.current()
        if found is None:
            return {"state": self.build_state()}
        chunks = found.table("chunks")
        counts = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("path").alias("files"), F.count("vector").alias("vectors")).first().asDict()
        return {"state": self.build_state(), **found.metadata, **counts, "symbols": found.table("symbols").count()}


def _alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except (ProcessLookupError, OverflowError):
        return False
    except PermissionError:
        return True
    return True


def worktree_main(path: str) -> str | None:
    """The main checkout of a linked git worktree, else None."""
    folder = os.path.realpath(path)
    while True:
        marker = os.path.join(folder, ".git")
        if os.path.isfile(marker):
            with open(marker, encoding="utf-8") as f:
                line = f.read().strip()
            if not line.startswith("gitdir:"):
                return None
            git = os.path.normpath(os.path.join(folder, line.removeprefix("gitdir:").strip()))
            head, sep, _ = git.partition(f"{os.sep}.git{os.sep}worktrees{os.sep}")
            return head if sep else None
        if os.path.isdir(marker) or os.path.dirname(folder) == folder:
            return None
        folder = os.path.dirname(folder)


def check_model(meta: dict, model: str, dim: int) -> None:
    """Raise if an index was built with another embedder."""
    if meta["embedding_model"] != model or meta["vector_dim"] != dim:
        raise ValueError(f"the index holds {meta['embedding_model']} vectors of {meta['vector_dim']}; rebuild it for {model} ({dim})")
