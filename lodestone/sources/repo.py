"""A source tree as a Spark data source, and its files as rows."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..constants import MAX_FILE_BYTES
from ..functions import paths
from ..operators.graph import Graph
from .. import schemas

IGNORE_FILES = (".gitignore", ".ignore")


class RepoSource(DataSource):
    """``spark.read.format("repo").load(root)``: path, length, modified_at, content of the files kept.

    A partition is one entry at the top of the tree, so that walking spreads over the executors
    (the tree has to be reachable from them, like any input).
    """

    @classmethod
    def name(cls) -> str:
        return "repo"

    def schema(self) -> str:
        return "path string, length bigint, modified_at timestamp, content binary"

    def reader(self, schema):
        return RepoReader(self.options["path"], self.options.get("ignore_file", ""), self.options.get("user_ignore", ""), self.options.get("only"))


class RepoReader(DataSourceReader):
    def __init__(self, root: str, ignore_file: str, user: str = "", only: str | None = None):
        self.only = None if only is None else json.loads(only)
        self.root, self.user, self.ignore = root, user, (*IGNORE_FILES, *([ignore_file] if ignore_file else []))

    def partitions(self):
        if self.only is not None:
            return [InputPartition(p) for p in self.only] or [InputPartition("")]
        return [InputPartition(e) for e in sorted(os.listdir(self.root)) if not e.startswith(".")] or [InputPartition("")]

    def read(self, partition):
        if not partition.value:
            return
        for rel in walk(self.root, partition.value, self.ignore, self.user):
            full = os.path.join(self.root, rel)
            try:
                info = os.stat(full)
                with open(full, "rb") as f:
                    content = f.read(MAX_FILE_BYTES + 1)
            except OSError:
                continue
            yield rel, info.st_size, datetime.fromtimestamp(info.st_mtime, UTC), content


def global_ignore() -> str:
    """The user's own ignore file, where git looks for it by default."""
    return os.path.join(os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config"), "git", "ignore")


def outer_rules(root: str, names: tuple[str, ...], user: str = "") -> list[tuple[str, list]]:
    """(folder, rules) that hold for a tree from outside it, weakest first: the user's ignore file, the
    repository's exclude file and the ignore files of the folders above."""
    root = os.path.realpath(root)
    above, folder = [], root
    while os.path.dirname(folder) != folder and not os.path.exists(os.path.join(folder, ".git")):
        folder = os.path.dirname(folder)
        above.append(folder)
    top = folder if os.path.exists(os.path.join(folder, ".git")) else root
    out = [(top, ignore_rules("", (user or global_ignore(),))), (top, ignore_rules(top, (os.path.join(".git", "info", "exclude"),)))]
    return [x for x in [*out, *((f, ignore_rules(f, names)) for f in reversed(above))] if x[1]]


def ignore_rules(folder: str, names: tuple[str, ...]) -> list[tuple[str, bool, bool, bool]]:
    """(regex, negated, directories only, anchored) of the ignore files in a folder."""
    out = []
    for name in names:
        try:
            with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                lines = f.read().split("\n")
        except OSError:
            continue
        for line in lines:
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            negated, line = line.startswith("!"), line.removeprefix("!")
            folder_only, line = line.endswith("/"), line.rstrip("/")
            anchored = "/" in line
            rx = paths.glob_regex(line.lstrip("/"))
            if rx:
                out.append((rx.replace(".*", "[^/]*") if "**" not in line else rx, negated, folder_only, anchored))
    return out


def walk(root: str, entry: str, names: tuple[str, ...], user: str = "") -> Iterator[str]:
    """Relative paths of regular files below ``entry``: no hidden entries, no links, ignore files honoured."""
    import re

    def ignored(rel: str, is_dir: bool, stack: list[tuple[str, list]]) -> bool:
        out = False
        for base, rules in stack:
            inner = os.path.relpath(os.path.join(whole, rel), base)
            for rx, negated, folder_only, anchored in rules:
                if (is_dir or not folder_only) and re.match(rx, inner if anchored else os.path.basename(rel)):
                    out = not negated
        return out

    def visit(rel: str, stack: list) -> Iterator[str]:
        full = os.path.join(root, rel)
        is_dir = os.path.isdir(full)
        if os.path.basename(rel).startswith(".") or os.path.islink(full) or ignored(rel, is_dir, stack):
            return
        if is_dir:
            deeper = [*stack, (os.path.join(whole, rel), ignore_rules(full, names))]
            for e in sorted(os.listdir(full)):
                yield from visit(os.path.join(rel, e), deeper)
        elif os.path.isfile(full):
            yield rel

    whole = os.path.realpath(root)
    stack = [*outer_rules(root, names, user), (whole, ignore_rules(root, names))]
    # the folders on the way to the entry may hide or ignore it
    parts, way = entry.split(os.sep), ""
    if ".." in parts:
        return
    for part in parts[:-1]:
        way = os.path.join(way, part)
        if part.startswith(".") or os.path.islink(os.path.join(root, way)) or ignored(way, True, stack):
            return
        stack = [*stack, (os.path.join(whole, way), ignore_rules(os.path.join(root, way), names))]
    yield from visit(entry, stack)


def read_repo(spark: SparkSession, root: str, ignore_file: str = "") -> DataFrame:
    spark.dataSource.register(RepoSource)
    return spark.read.format("repo").option("ignore_file", ignore_file).option("user_ignore", global_ignore()).load(root)


def read_paths(spark: SparkSession, root: str, only: list[str], ignore_file: str = "") -> DataFrame:
    """The rows of ``read_repo`` at or below the given relative paths; nothing else is listed or read."""
    spark.dataSource.register(RepoSource)
    reader = spark.read.format("repo").option("ignore_file", ignore_file).option("user_ignore", global_ignore())
    return reader.option("only", json.dumps(sorted(set(only)))).load(root)


def text_files(raw: DataFrame) -> DataFrame:
    """Rows of ``schemas.FILES``: kept by path and size, valid UTF-8, with their languages."""
    kept = raw.where(paths.ingestible(F.col("path"), F.col("length")))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return kept.select(
        "path", paths.language(F.col("path")).alias("language"), paths.graph_language(F.col("path")).alias("graph_language"), text.alias("text"), "length", "modified_at"
    ).where(F.col("text").isNotNull())


def symbol_graph(files: DataFrame) -> Graph:
    """Symbols, edges and imports of all files, parsed in one pass."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .syntax import extract

        for part in parts:
            rows = []
            for f in part.itertuples():
                s, e, i = extract(f.text, f.path, f.graph_language)
                rows.append((s, e, i))
            yield pd.DataFrame(
                {
                    "symbols": [[dict(zip(schemas.SYMBOLS.names, x, strict=True)) for x in r[0]] for r in rows],
                    "edges": [[dict(zip(schemas.EDGES.names, x, strict=True)) for x in r[1]] for r in rows],
                    "imports": [[dict(zip(schemas.IMPORTS.names, x, strict=True)) for x in r[2]] for r in rows],
                }
            )

    schema = ", ".join(f"{n} array<{s.simpleString()}>" for n, s in (("symbols", schemas.SYMBOLS), ("edges", schemas.EDGES), ("imports", schemas.IMPORTS)))
    parsed = files.where("graph_language is not null").select("path", "text", "graph_language").mapInPandas(run, schema)
    return Graph(*(parsed.select(F.inline(c)) for c in ("symbols", "edges", "imports")))


def below(path: Column, root: str) -> Column:
    """Paths below ``root`` as it is written, or as its links resolve, without it; others as they are."""
    out = path
    for base in dict.fromkeys((root.rstrip("/") + "/", os.path.realpath(root).rstrip("/") + "/")):
        out = F.when(F.startswith(path, F.lit(base)), F.substring(path, F.lit(len(base) + 1), F.length(path))).otherwise(out)
    return out


def relative(path: str, root: str) -> str:
    """``path`` below ``root``; a deleted file's parent is resolved instead of itself."""
    if path.startswith(root.rstrip("/") + "/"):
        return path[len(root.rstrip("/")) + 1 :]
    if not os.path.isabs(path):
        return path
    real = os.path.realpath(path) if os.path.exists(path) else os.path.join(os.path.realpath(os.path.dirname(path)), os.path.basename(path))
    base = os.path.realpath(root).rstrip("/") + "/"
    return real[len(base) :] if real.startswith(base) else real
