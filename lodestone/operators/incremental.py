"""Keeping tables fresh: cache joins, deletions, upserts and change sets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rank import best_row


def cache_join(chunks: DataFrame, cache: DataFrame, key: str = "hash") -> DataFrame:
    """chunks with the cached ``vector`` of an equal hash, and ``hit``."""
    known = cache.groupBy(key).agg(F.first("vector").alias("vector"), F.lit(True).alias("__hit"))
    return chunks.join(known, key, "left").withColumn("hit", F.coalesce("__hit", F.lit(False))).drop("__hit")


def misses(chunks: DataFrame, cache: DataFrame, key: str = "hash") -> DataFrame:
    return chunks.join(cache.select(key).distinct(), key, "left_anti")


def hit_ratio(joined: DataFrame) -> DataFrame:
    """Rows, hits and their ratio (0 of nothing)."""
    return joined.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(F.col("hit").cast("bigint")), F.lit(0)).alias("hits")).withColumn(
        "ratio", F.when(F.col("total") == 0, 0.0).otherwise(F.col("hits") / F.col("total"))
    )


def completed_files(joined: DataFrame, path: str = "path", done: str = "hit") -> DataFrame:
    return joined.groupBy(path).agg(F.bool_and(done).alias("complete"), F.count(F.lit(1)).alias("chunks"))


def ancestors(path: Column) -> Column:
    """The path itself and every directory above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def delete_paths(chunks: DataFrame, gone: DataFrame, path: str = "path") -> DataFrame:
    """Without rows at a deleted path or under it.

    A row's ancestors are matched by equality, so that the join hashes instead of
    comparing every prefix with every row.
    """
    dead = gone.select(F.col(path).alias("__gone")).distinct()
    hit = (
        chunks.select(path).distinct().select(F.col(path).alias("__at"), F.explode(ancestors(F.col(path))).alias("__gone"))
        .join(dead, "__gone", "left_semi").select("__at").distinct()
    )
    return chunks.join(hit, F.col(path) == F.col("__at"), "left_anti")


def last_event(changes: DataFrame, path: str = "path", ts: str = "ts", order: str | None = None) -> DataFrame:
    """The last change of each path."""
    whole = F.struct(*[F.col(c) for c in changes.columns])
    latest = F.max_by(whole, F.struct(ts, *([order] if order else [])))
    return changes.groupBy(F.col(path).alias("__key")).agg(latest.alias("__row")).select("__row.*")


def apply_changes(chunks: DataFrame, changes: DataFrame, fresh: DataFrame, path: str = "path") -> DataFrame:
    """Deletions first (exact or prefix), then touched paths replaced by their ``fresh`` rows."""
    kept = delete_paths(chunks, changes.where("op = 'deleted'"), path)
    touched = changes.where("op = 'touched'").select(path).distinct()
    return kept.join(touched, path, "left_anti").unionByName(fresh.join(touched, path, "left_semi"), allowMissingColumns=True)


def keep_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the first by ``order``."""
    return best_row(rows, key, F.col(order))


# --- change events ---------------------------------------------------------


def categorise(events: DataFrame, kind: str = "kind", paths: str = "paths") -> DataFrame:
    """One (path, op) row for each path that an event touches or deletes.

    remove deletes; rename deletes its first path and touches the others; access
    is ignored; anything else touches.
    """
    op = F.transform(
        F.col(paths),
        lambda p, i: F.struct(
            p.alias("path"),
            F.when((F.col(kind) == "remove") | ((F.col(kind) == "rename") & (i == 0)), F.lit("deleted")).otherwise(F.lit("touched")).alias("op"),
        ),
    )
    keep = [c for c in events.columns if c not in (kind, paths)]
    return events.where(F.col(kind) != "access").select(*keep, F.explode(op).alias("__c")).select(*keep, "__c.path", "__c.op")


def sessions(changes: DataFrame, ts: str = "ts", gap: str = "500 milliseconds", keys: tuple[str, ...] = ()) -> DataFrame:
    """Debounced bursts: events no further apart than ``gap``, with their distinct paths.

    A stream keeps a session in state; without ``keys`` all its events share one key.  A table is first
    reduced to stretches of ``gap``, whose events belong together anyway, so that only the stretches
    are put in order, and to its distinct paths in each.
    """
    return (_stream_sessions if changes.isStreaming else _table_sessions)(changes, ts, gap, keys)


def _paths_of(op: str) -> Column:
    return F.array_sort(F.collect_set(F.when(F.col("op") == op, F.col("path"))))


def _stream_sessions(changes: DataFrame, ts: str, gap: str, keys: tuple[str, ...]) -> DataFrame:
    scope = list(keys) or [(F.length("path") >= 0).alias("__all")]
    return (
        changes.groupBy(F.session_window(ts, gap).alias("w"), *scope)
        .agg(F.count(F.lit(1)).alias("n_events"), _paths_of("touched").alias("touched"), _paths_of("deleted").alias("deleted"))
        .select(*keys, F.col("w.start").alias("started"), F.col("w.end").alias("ends"), "n_events", "touched", "deleted")
    )


def _table_sessions(changes: DataFrame, ts: str, gap: str, keys: tuple[str, ...]) -> DataFrame:
    micros = int(pd.Timedelta(gap).total_seconds() * 1_000_000)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = changes.select(*keys, "path", "op", F.col(ts).alias("__ts"), F.floor(at / micros).alias("__stretch")).where("__ts is not null")
    per = rows.groupBy(*keys, "__stretch", "path", "op").agg(F.min("__ts").alias("__lo"), F.max("__ts").alias("__hi"), F.count(F.lit(1)).alias("__n"))
    stretches = per.groupBy(*keys, "__stretch").agg(F.min("__lo").alias("lo"), F.max("__hi").alias("hi"), F.sum("__n").alias("n"))
    w = Window.partitionBy(*keys).orderBy("__stretch")
    wait = F.unix_micros(F.col("lo").cast("timestamp")) - F.unix_micros(F.lag("hi").over(w).cast("timestamp"))
    fresh = stretches.withColumn("__new", F.when(wait <= micros, 0).otherwise(1))
    numbered = fresh.withColumn("__session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = numbered.groupBy(*keys, "__session").agg(F.min("lo").alias("started"), F.max("hi").alias("__last"), F.sum("n").alias("n_events"))
    held = per.join(numbered.select(*keys, "__stretch", "__session"), [*keys, "__stretch"]).select(*keys, "__session", "path", "op").distinct()
    held = held.groupBy(*keys, "__session").agg(_paths_of("touched").alias("touched"), _paths_of("deleted").alias("deleted"))
    ends = (F.col("__last") + F.expr(f"interval '{micros / 1_000_000:.6f}' second")).alias("ends")
    return spans.join(held, [*keys, "__session"]).select(*keys, "started", ends, "n_events", "touched", "deleted")
