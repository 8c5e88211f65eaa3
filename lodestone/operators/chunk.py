"""Files into chunks: native line windows, and syntax-aware spans in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MAX_CHUNK_BYTES, WINDOW_LINES
from ..functions import text as tx


def line_windows(files: DataFrame, path: str = "path", text: str = "text", size: int = WINDOW_LINES) -> DataFrame:
    """Tumbling windows of lines: the file's columns, start_line, end_line, snippet.

    An empty file gives one empty window.
    """
    ls = tx.lines(F.col(text))
    starts = F.sequence(F.lit(0), F.greatest(F.size("__lines") - 1, F.lit(0)), F.lit(size))
    rows = files.withColumn("__lines", ls).withColumn("__at", F.explode(starts))
    piece = F.slice("__lines", F.col("__at") + 1, F.lit(size))
    return rows.select(
        *files.columns,
        F.when(F.size("__lines") == 0, 1).otherwise(F.col("__at") + 1).alias("start_line"),
        F.least(F.col("__at") + size, F.size("__lines")).alias("end_line"),
        F.array_join(piece, "\n").alias("snippet"),
    )


def chunk_id(path: Column, start: Column, end: Column) -> Column:
    """A stable id: the same place in the same file has the same one."""
    return F.sha2(F.concat_ws(":", path, start.cast("string"), end.cast("string")), 256)


def build(windows: DataFrame, path: str = "path") -> DataFrame:
    """path header plus the trimmed snippet, at most 8192 bytes, with its hash and id."""
    body = F.concat(F.lit("// File: "), F.col(path), F.lit("\n"), F.regexp_replace("snippet", r"^\s+|\s+$", ""))
    keep = [c for c in windows.columns if c not in ("snippet", "text")]
    return (
        windows.select(*keep, tx.truncate_bytes(body, MAX_CHUNK_BYTES).alias("text"))
        .withColumn("hash", F.sha2("text", 256))
        .withColumn("id", chunk_id(F.col(path), F.col("start_line"), F.col("end_line")))
    )


def chunk_files(files: DataFrame) -> DataFrame:
    """(path, language, text, modified_at) rows to chunks (see ``schemas.CHUNKS``).

    Files whose text is blank give no chunk; those without semantic spans fall back to line windows.
    """
    from ..sources.syntax import semantic_chunks

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for f in part.itertuples():
                if not f.text or not f.text.strip():
                    continue
                found = semantic_chunks(f.text, f.language)
                if found is None:
                    found = [(None, None, None)]
                out += [(f.path, f.language, f.modified_at, a, b, s, f.text if a is None else None) for a, b, s in found]
            yield pd.DataFrame(out, columns=["path", "language", "modified_at", "start_line", "end_line", "snippet", "text"])

    schema = "path string, language string, modified_at timestamp, start_line int, end_line int, snippet string, text string"
    spans = files.select("path", "language", "text", "modified_at").mapInPandas(run, schema)
    semantic = spans.where("start_line is not null").drop("text")
    plain = line_windows(spans.where("start_line is null").select("path", "language", "modified_at", "text")).drop("text")
    return build(semantic.unionByName(plain)).select("id", "path", "language", "start_line", "end_line", "text", "hash", "modified_at")
