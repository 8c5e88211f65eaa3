"""One-hop queries and maintenance over the symbol graph's three tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import GRAPH_BASE, GRAPH_GAIN
from ..functions import vectors


@dataclass
class Graph:
    symbols: DataFrame
    edges: DataFrame
    imports: DataFrame

    def symbol(self, symbol_id: str) -> DataFrame:
        return self.symbols.where(F.col("id") == symbol_id)

    def add_symbols(self, rows: DataFrame) -> Graph:
        """With more symbols; one whose id is there already replaces it."""
        kept = self.symbols.join(rows.select("id"), "id", "left_anti").select(*self.symbols.columns)
        return Graph(kept.unionByName(rows), self.edges, self.imports)

    def add_edges(self, rows: DataFrame) -> Graph:
        return Graph(self.symbols, self.edges.unionByName(rows), self.imports)

    def add_imports(self, rows: DataFrame) -> Graph:
        return Graph(self.symbols, self.edges, self.imports.unionByName(rows))

    def by_name(self, name: str) -> DataFrame:
        return self.symbols.where(F.col("name") == name)

    def by_prefix(self, prefix: str) -> DataFrame:
        return self.symbols.where(F.startswith(F.lower("name"), F.lit(prefix.lower())))

    def in_file(self, path: str) -> DataFrame:
        return self.symbols.where(F.col("file_path") == path)

    def of_kind(self, kind: str) -> DataFrame:
        return self.symbols.where(F.col("kind") == kind)

    def definitions(self, name: str, kind: str | None = None) -> DataFrame:
        found = self.by_name(name)
        return found if kind is None else found.where(F.col("kind") == kind)

    def outgoing(self, symbol_id: str) -> DataFrame:
        return self.edges.where(F.col("source_id") == symbol_id)

    def incoming(self, symbol_id: str) -> DataFrame:
        return self.edges.where(F.col("target_id") == symbol_id)

    def _ends(self, here: str, there: str, symbol_id: str | None, kind: str) -> DataFrame:
        """The symbols at the far end of edges of a kind, one row an edge; dangling ends drop out."""
        e = self.edges.where(F.col("kind") == kind)
        e = e if symbol_id is None else e.where(F.col(here) == symbol_id)
        e = e.select(F.col(here).alias("of_id"), F.col(there).alias("id"))
        return e.join(self.symbols, "id")

    def callers(self, symbol_id: str | None = None) -> DataFrame:
        return self._ends("target_id", "source_id", symbol_id, "calls")

    def callees(self, symbol_id: str | None = None) -> DataFrame:
        return self._ends("source_id", "target_id", symbol_id, "calls")

    def implementors(self, symbol_id: str | None = None) -> DataFrame:
        return self._ends("target_id", "source_id", symbol_id, "implements")

    def implementations(self, symbol_id: str | None = None) -> DataFrame:
        return self._ends("source_id", "target_id", symbol_id, "implements")

    def importers(self, path: str) -> DataFrame:
        """Files whose import target contains the path or is contained in it."""
        t = F.col("target_path")
        return self.imports.where(F.contains(t, F.lit(path)) | F.contains(F.lit(path), t)).select("source_file")

    def imports_of(self, path: str) -> DataFrame:
        return self.imports.where(F.col("source_file") == path)

    def stats(self) -> DataFrame:
        """metric, value: totals, distinct files and a row for each kind of symbol."""
        s = self.symbols
        one = lambda name, df: df.select(F.lit(name).alias("metric"), F.col("v").cast("bigint").alias("value"))
        return (
            one("symbols", s.agg(F.count(F.lit(1)).alias("v")))
            .unionByName(one("files", s.agg(F.count_distinct("file_path").alias("v"))))
            .unionByName(one("edges", self.edges.agg(F.count(F.lit(1)).alias("v"))))
            .unionByName(one("imports", self.imports.agg(F.count(F.lit(1)).alias("v"))))
            .unionByName(s.groupBy("kind").agg(F.count(F.lit(1)).alias("value")).select(F.concat(F.lit("kind:"), F.col("kind")).alias("metric"), "value"))
        )

    def merge(self, other: Graph) -> Graph:
        return Graph(self.symbols.unionByName(other.symbols), self.edges.unionByName(other.edges), self.imports.unionByName(other.imports))

    def remove_files(self, paths: DataFrame, column: str = "path") -> Graph:
        """Without the files' symbols, every edge that touches one, and the files' imports."""
        gone = paths.select(F.col(column).alias("__p")).distinct()
        ids = self.symbols.join(gone, F.col("file_path") == F.col("__p"), "left_semi").select(F.col("id").alias("__id"))
        return Graph(
            self.symbols.join(gone, F.col("file_path") == F.col("__p"), "left_anti"),
            self.edges.join(ids, F.col("source_id") == F.col("__id"), "left_anti").join(ids, F.col("target_id") == F.col("__id"), "left_anti"),
            self.imports.join(gone, F.col("source_file") == F.col("__p"), "left_anti"),
        )

    def resolve_calls(self) -> Graph:
        """Extension: calls edges without a target get one per symbol that bears the callee's name."""
        named = self.symbols.where(F.col("kind").isin("function", "method")).select(F.col("id").alias("__to"), F.col("name").alias("__name"))
        open_ = self.edges.where((F.col("kind") == "calls") & F.col("target_id").isNull())
        last = F.element_at(F.split("metadata", r"\.|::|->"), -1)
        found = open_.join(named, last == F.col("__name")).select("source_id", F.col("__to").alias("target_id"), "kind", "metadata")
        rest = self.edges.where(~((F.col("kind") == "calls") & F.col("target_id").isNull()))
        return Graph(self.symbols, rest.unionByName(found), self.imports)


def symbols_in_chunks(symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """All (symbol, chunk) with the symbol's lines within the chunk's: a hash join on the path."""
    s = symbols.select(F.col("id").alias("symbol_id"), "name", F.col("file_path").alias("__p"), F.col("start_line").alias("__s"), F.col("end_line").alias("__e"))
    on = (F.col("__p") == F.col("path")) & (F.col("start_line") <= F.col("__s")) & (F.col("__e") <= F.col("end_line"))
    return s.join(chunks, on).drop("__p", "__s", "__e")


def first_chunk_results(symbols: DataFrame, chunks: DataFrame, query: Column, limit: int, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """For the first ``limit`` symbols, the first chunk that contains each, scored 0.8 + 0.2 cosine."""
    first = symbols.orderBy(*order).limit(limit)
    w = Window.partitionBy("symbol_id").orderBy("chunk_idx")
    found = symbols_in_chunks(first, chunks).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    semantic = vectors.cosine(F.col("vector"), query)
    return found.withColumn("semantic", semantic).withColumn("score", GRAPH_BASE + GRAPH_GAIN * F.col("semantic"))


def chunk_symbol_names(symbols: DataFrame, chunks: DataFrame, key: str = "chunk_idx") -> DataFrame:
    """chunks with ``symbols``, the names of the symbols within each (null: none)."""
    names = symbols_in_chunks(symbols, chunks).groupBy(key).agg(F.array_sort(F.collect_list("name")).alias("symbols"))
    return chunks.join(names, key, "left")
