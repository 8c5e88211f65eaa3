"""The engine's verbs: index, update, search, watch, and graph, file and directory queries."""

from __future__ import annotations

import json
import os
import time
import tomllib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .constants import ANN_FROM, DEBOUNCE_MS, FORMAT_VERSION
from .embed import Embedder, HashingEmbedder, batch_size, embed_chunks
from .functions import text as tx
from .functions import vectors
from .operators import chunk, graph, hierarchy, incremental, lexical
from .operators.ann import Cells
from .plans.planner import Lexicon, SearchOptions, fields_of, rank_remote, remote_fetch_size, search
from .sources import repo
from .sources.remote import RemoteStore, push, withdraw
from .sources.store import BUCKETS, Snapshot, Store, bucket_of, check_model, worktree_main
from .streaming import watch as streams


@dataclass
class Report:
    mode: str
    files: int
    chunks: int
    cache_hits: int
    seconds: dict[str, float]


class Engine:
    def __init__(self, spark: SparkSession, root: str, store: str, embedder: Embedder | None = None, main_store: str | None = None, batch: int | None = None):
        self.spark, self.root, self.embedder, self.batch = spark, root, embedder or HashingEmbedder(), batch_size(batch)
        self.store = Store(spark, store)
        #: the latest snapshot's postings, and how often a search found them at hand
        self.lexicon_of, self.lexicon_hits, self.lexicon_misses = None, 0, 0
        if main_store and worktree_main(root):
            self.store.clone_from(Store(spark, main_store))

    # --- building ------------------------------------------------------------

    def index(self, force: bool = False, changes: DataFrame | None = None) -> Report:
        """Build in full, or apply ``changes`` (path, op) to a reusable snapshot."""
        old = None if force else self.store.current()
        reusable = old is not None and old.metadata["vector_dim"] == self.embedder.dimension and old.metadata["embedding_model"] == self.embedder.name
        with self.store.building():
            if reusable and changes is not None and not changes.isEmpty():
                return self._incremental(old, changes)
            return self._full(old if reusable else None)

    def _files(self) -> DataFrame:
        return repo.text_files(repo.read_repo(self.spark, self.root))

    def _full(self, old: Snapshot | None) -> Report:
        t = time.time()
        files = self._files().persist()
        n_files = files.count()
        walked = time.time()
        chunks = chunk.chunk_files(files).persist()
        chunks.count()
        parsed = time.time()
        g = repo.symbol_graph(files)
        cache = None if old is None else old.table("chunks").select("hash", "vector")
        report = self._finish(chunks, g, cache, "full", {"walk": walked - t, "chunk": parsed - walked}, n_files=n_files)
        files.unpersist()
        chunks.unpersist()
        return report

    def _incremental(self, old: Snapshot, changes: DataFrame) -> Report:
        """Read the touched paths alone and write the buckets in which a path came, changed or went."""
        t = time.time()
        everything = changes.select("path").distinct()
        touched = [r["path"] for r in changes.where("op = 'touched'").select("path").distinct().collect()]
        now = repo.text_files(repo.read_paths(self.spark, self.root, touched)).dropDuplicates(["path"]).persist()
        had = old.table("files").select("path")
        lost = had.join(incremental.delete_paths(had, everything), "path", "left_anti")
        buckets = sorted(r[0] for r in lost.unionByName(now.select("path")).select(bucket_of(F.col("path"))).distinct().collect())
        walked = time.time()
        columns = ["id", "path", "language", "start_line", "end_line", "text", "hash", "modified_at"]
        before = old.table("chunks", buckets)
        chunks = incremental.delete_paths(before.select(*columns), everything).unionByName(chunk.chunk_files(now)).persist()
        chunks.count()
        parsed = time.time()
        dead = old.table("symbols").select(F.col("file_path").alias("path")).distinct()
        gone = dead.join(incremental.delete_paths(dead, everything), "path", "left_anti")
        g = old.graph.remove_files(gone).merge(repo.symbol_graph(now))
        report = self._finish(chunks, g, before.select("hash", "vector"), "incremental", {"walk": walked - t, "chunk": parsed - walked}, old, buckets)
        now.unpersist()
        chunks.unpersist()
        return report

    def _finish(self, chunks: DataFrame, g: graph.Graph, cache: DataFrame | None, mode: str, seconds: dict[str, float], base: Snapshot | None = None, buckets: tuple | list = (), n_files: int | None = None) -> Report:
        t = time.time()
        ranked = chunks.withColumn("chunk_idx", F.xxhash64("id")).withColumn("bucket", bucket_of(F.col("path")))
        embedded = embed_chunks(ranked, self.embedder, cache, size=self.batch).withColumn("bits", vectors.quantise(F.col("vector")))
        named = graph.chunk_symbol_names(g.symbols, embedded)
        fields = fields_of(named)
        named = named.join(lexical.lengths(named, "chunk_idx", fields), "chunk_idx").persist()
        n = named.count()
        embedded_at = time.time()
        # an update keeps the centres of its base: they are fitted anew by a full build
        cells = base.cells if base is not None else Cells.fit(named) if n >= ANN_FROM else None
        rest = [] if base is None else [b for b in range(BUCKETS) if b not in set(buckets)]
        files = hierarchy.files(named).withColumn("bucket", bucket_of(F.col("path")))
        lengths, all_files = named.select("dl"), files.drop("bucket")
        if base is not None:
            lengths = lengths.unionByName(base.table("chunks", rest).select("dl"))
            all_files = all_files.unionByName(base.table("files", rest))
        tables = {
            "chunks": named if cells is None else cells.assign(named), "postings": lexical.postings(named, "chunk_idx", fields_of(named), "bucket"), "files": files,
            "corpus": lexical.corpus_stats(lengths), "directories": hierarchy.directories(all_files), "symbols": g.symbols, "edges": g.edges, "imports": g.imports,
        }
        hits = 0 if cache is None else chunks.join(cache.select("hash"), "hash", "left_semi").count()
        snap = self.store.save(tables, self.root, self.embedder.dimension, self.embedder.name, n_files, cells, base, buckets)
        named.unpersist()
        return Report(mode, snap.metadata["total_files"], snap.metadata["total_chunks"], hits, {**seconds, "embed": embedded_at - t, "build": time.time() - embedded_at})

    # --- reading ---------------------------------------------------------------

    def snapshot(self) -> Snapshot:
        state = self.store.build_state()
        found = self.store.current()
        if found is None:
            raise LookupError(f"no index here ({state}); build one first")
        check_model(found.metadata, self.embedder.name, self.embedder.dimension)
        return found

    def verify(self) -> None:
        """Raise if the live snapshot does not hold what its metadata says."""
        self.snapshot().verify()

    def _embed(self, query: str) -> list[float]:
        return self.embedder.embed_batch([query])[0]

    def search(self, query: str, options: SearchOptions | None = None) -> DataFrame:
        options = options or SearchOptions()
        snap = self.snapshot()
        found = search(snap.table("chunks"), query, self._embed, options, snap.metadata["total_chunks"], self._lexicon(snap), snap.cells)
        return found.withColumn("snippet", tx.snippet(F.col("text"), options.full_context))

    def _lexicon(self, snap: Snapshot) -> Lexicon:
        if self.lexicon_of is not None and self.lexicon_of[0] == snap.snap:
            self.lexicon_hits += 1
        else:
            self.lexicon_misses += 1
            self.lexicon_of = snap.snap, Lexicon(snap.table("postings"), snap.table("corpus"))
        return self.lexicon_of[1]

    def search_files(self, query: str, limit: int = 10) -> DataFrame:
        return hierarchy.search(self.snapshot().table("files"), vectors.literal(self._embed(query)), limit)

    def search_directories(self, query: str, limit: int = 10) -> DataFrame:
        return hierarchy.search(self.snapshot().table("directories"), vectors.literal(self._embed(query)), limit)

    def search_remote(self, query: str, remote: RemoteStore, limit: int = 10) -> DataFrame:
        hits = remote.query(self._embed(query), remote_fetch_size(limit))
        schema = "id string, path string, start_line int, end_line int, text string, language string, symbols array<string>, score double"
        rows = [(h["id"], h["path"], h["start_line"], h["end_line"], h["content"], h["language"], list(h.get("symbols") or []), float(h["score"])) for h in hits]
        return rank_remote(self.spark.createDataFrame(rows, schema), query, limit, self.snapshot().table("symbols").select("name"))

    def graph(self) -> graph.Graph:
        return self.snapshot().graph

    def stats(self) -> dict:
        return self.store.stats()

    # --- upkeep ------------------------------------------------------------------

    def push(self, remote: RemoteStore, reset: bool = False) -> None:
        push(self.snapshot().table("chunks"), remote, reset)

    def push_changes(self, remote: RemoteStore, before: Snapshot | None) -> None:
        """Upload the chunks that are new or moved since ``before`` and delete the ones that are gone."""
        now, place = self.snapshot().table("chunks"), ["hash", "start_line", "end_line"]
        if before is None:
            push(now, remote, reset=True)
            return
        old = before.table("chunks")
        push(now.join(old.select(*place), place, "left_anti"), remote)
        withdraw(old.join(now.select("hash"), "hash", "left_anti"), remote)

    def watch(self, events_folder: str | None, checkpoint: str, remote: RemoteStore | None = None, once: bool = False, debounce_ms: int = DEBOUNCE_MS):
        """Keep the index fresh from a stream of notifications, or from the tree itself where no folder
        of them is given; builds a first index where there is none."""
        if self.store.current() is None:
            self.index()

        def apply(changes: DataFrame) -> None:
            before = self.store.current()
            self.index(changes=changes.withColumn("path", repo.below(F.col("path"), self.root)))
            if remote is not None:
                self.push_changes(remote, before)

        events = streams.read_events(self.spark, events_folder) if events_folder else streams.read_tree(self.spark, self.root, f"{checkpoint}-tree")
        return streams.run(events, apply, checkpoint, debounce_ms, once)


def to_json(results: DataFrame, query: str, limit: int, duration_ms: int, meta: dict) -> str:
    """The result document of a search."""
    rows = results.select("path", "start_line", "end_line", "language", "score", F.col("semantic").alias("semantic_score"), "snippet").collect()
    index = {k: meta[k] for k in ("repo_path", "repo_hash", "vector_dim", "total_files", "total_chunks")} | {"indexed_at": meta["indexed_at"].isoformat()}
    return json.dumps({"query": query, "limit": limit, "duration_ms": duration_ms, "results": [r.asDict() for r in rows], "index": index})


def to_text(results: DataFrame) -> tuple[str, int]:
    """Printable results and the exit status: 0 with matches, 1 without."""
    rows = results.select("path", "start_line", "end_line", "score", "snippet").collect()
    return "\n\n".join(f"{r['path']}:{r['start_line']}-{r['end_line']} ({r['score']:.3f})\n{r['snippet']}" for r in rows), 0 if rows else 1


def parse_bool(value: str) -> bool:
    low = value.strip().lower()
    if low in ("1", "true", "yes", "on", "y", "t"):
        return True
    if low in ("0", "false", "no", "off", "n", "f"):
        return False
    raise ValueError(f"not a truth value: {value}")


def load_config(path: str | None = None) -> dict:
    """TOML settings from ``path`` or LODESTONE_CONFIG; empty without a file."""
    path = path or os.environ.get("LODESTONE_CONFIG", "")
    if not path or not os.path.exists(path):
        return {}
    with open(path, "rb") as f:
        return tomllib.load(f)


__all__ = ["Engine", "FORMAT_VERSION", "Report", "SearchOptions", "load_config", "parse_bool", "to_json", "to_text"]
