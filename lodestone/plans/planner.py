"""Search as one plan: access path, scoring, feedback, priors, limit, suppression."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import (
    ANN_FROM, ANN_OVERSAMPLE, BINARY_FROM, BINARY_OVERSAMPLE, DEFAULT_LIMIT, DUPLICATE_COSINE, PRF_DOCS, REMOTE_LEAST, REMOTE_OVERSAMPLE, SYMBOL_HIT_BOOST,
)
from ..functions import paths, vectors
from ..operators import ann, lexical, rank

Embed = Callable[[str], list[float]]


@dataclass
class SearchOptions:
    limit: int = DEFAULT_LIMIT
    glob: list[str] = field(default_factory=list)
    filters: list[str] = field(default_factory=list)
    full_context: bool = False
    dedup: bool = True
    threshold: float = DUPLICATE_COSINE
    strategy: str | None = None

    @property
    def pool(self) -> int:
        return max(PRF_DOCS, self.limit, 1)


def choose(n: int, options: SearchOptions) -> str:
    """Filters force the exact scan, so that none of their matches is lost; else size decides."""
    if options.strategy:
        return options.strategy
    if options.glob or options.filters:
        return "linear"
    return "binary" if n >= BINARY_FROM else "ann" if n >= ANN_FROM else "linear"


#: what ranking needs of a chunk; text and vectors are fetched for the few rows that remain
NARROW = ("id", "path", "language", "start_line")


def fields_of(chunks: DataFrame):
    symbols = F.col("symbols") if "symbols" in chunks.columns else None
    return lexical.boosted_fields(F.col("text"), F.col("path"), symbols)


@dataclass
class Lexicon:
    """Persisted postings, keyed by ``chunk_idx``, and the one row of corpus statistics."""

    postings: DataFrame
    stats: DataFrame


def _held(df: DataFrame, held: list[DataFrame] | None) -> DataFrame:
    """Kept while a search runs, where the caller lets go of it afterwards."""
    if held is None:
        return df
    held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return held[-1]


def _lexical(chunks: DataFrame, terms, lexicon: Lexicon | None, keep: list[str], held: list[DataFrame] | None) -> DataFrame:
    """The narrow columns with ``bm25``: from the persisted postings, or by one pass over the texts."""
    if lexicon is None:
        counted = lexical.count_terms(chunks, fields_of(chunks), terms)
        return lexical.score_counts(_held(counted.select(*keep, "__dl", *[f"__t{i}" for i in range(len(terms))]), held), terms)
    found = lexical.score_postings(lexicon.postings, lexicon.stats, "chunk_idx", terms)
    return _held(chunks.select(*keep).join(found, "chunk_idx", "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0))), held)


def shortlist(chunks: DataFrame, query_vector: list[float], size: int) -> DataFrame:
    """(chunk_idx, semantic) of the ``size`` rows with the nearest sign bits; only their vectors are compared."""
    q = vectors.literal(query_vector)
    bits = F.col("bits") if "bits" in chunks.columns else vectors.quantise(F.col("vector"))
    near = chunks.select("chunk_idx", vectors.hamming(bits, vectors.quantise(q)).alias("distance")).orderBy("distance", "chunk_idx").limit(size)
    return chunks.select("chunk_idx", "vector").join(F.broadcast(near), "chunk_idx").select("chunk_idx", vectors.cosine(F.col("vector"), q).alias("semantic"))


def neighbours(chunks: DataFrame, query_vector: list[float], size: int, cells: ann.Cells | None = None) -> DataFrame:
    """(chunk_idx, semantic) of the ``size`` nearest rows: of the index's cells that are nearest, or of all without one."""
    near = chunks if cells is None else chunks.where(cells.near(query_vector))
    return ann.exact(near.select("chunk_idx", "vector"), vectors.literal(query_vector), size).select("chunk_idx", "semantic")


def score_pass(
    chunks: DataFrame, query: str, query_vector: list[float], strategy: str, options: SearchOptions, lexicon: Lexicon | None = None, held: list[DataFrame] | None = None, cells: ann.Cells | None = None
) -> DataFrame:
    """Scored candidates: the narrow columns, chunk_idx, bm25 (raw), semantic and score.

    Lexical statistics are those of the whole corpus; the normalisation is that of the candidates.
    Tables kept meanwhile are added to ``held``.
    """
    keep = ["chunk_idx", *NARROW]
    terms = lexical.query_terms(chunks.sparkSession, query)
    if strategy in ("binary", "ann"):
        if strategy == "binary":
            near = shortlist(chunks, query_vector, options.pool * BINARY_OVERSAMPLE)
        else:
            near = neighbours(chunks, query_vector, options.pool * ANN_OVERSAMPLE, cells)
        if lexicon is not None:
            chunks = chunks.join(F.broadcast(near.select("chunk_idx")), "chunk_idx", "left_semi")
        rows = _lexical(chunks, terms, lexicon, keep, held).join(F.broadcast(near), "chunk_idx")
    else:
        rows = chunks.withColumn("semantic", vectors.cosine(F.col("vector"), vectors.literal(query_vector)))
        rows = _lexical(rows, terms, lexicon, [*keep, "semantic"], held)
        rows = rows.where(paths.glob_filter(F.col("path"), options.glob) & paths.metadata_filter(options.filters, F.col("path"), F.col("language")))
    return rank.normalise(rows).withColumn("score", rank.fuse(F.col("semantic"), F.col("bm25_norm")))


def with_chunks(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """A short result list with the chunks' other columns."""
    rest = [c for c in chunks.columns if c not in ranked.columns]
    return chunks.select("chunk_idx", *rest).join(F.broadcast(ranked), "chunk_idx")


def _listed(df: DataFrame) -> DataFrame:
    """A result list (bounded by the query's limit) as a local table, so that nothing is computed twice."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def search(chunks: DataFrame, query: str, embed: Embed, options: SearchOptions | None = None, n: int | None = None, lexicon: Lexicon | None = None, cells: ann.Cells | None = None) -> DataFrame:
    """Ranked chunks for a query.  ``chunks`` has chunk_idx, id, path, language, start_line, text, hash and vector.

    The ranking runs here; what comes back reads the listed chunks only.  Nothing stays cached.
    """
    options = options or SearchOptions()
    strategy = choose(chunks.count() if n is None else n, options)
    held: list[DataFrame] = []
    try:
        # a list of at most ``pool`` rows: it starts both the feedback and the merge
        first = _listed(rank.top(score_pass(chunks, query, embed(query), strategy, options, lexicon, held, cells), options.pool))
        expanded = rank.expand(query, rank.top(with_chunks(first, chunks), options.pool))
        merged = first
        if expanded != query:
            merged = rank.max_merge(first, score_pass(chunks, expanded, embed(expanded), strategy, options, lexicon, held, cells))
        ranked = _listed(rank.top(merged.withColumn("score", F.col("score") * paths.priority(F.col("path"))), options.limit))
    finally:
        for df in held:
            df.unpersist()
    ranked = with_chunks(ranked, chunks)
    return rank.suppress_near_duplicates(ranked, options.threshold) if options.dedup else ranked


def rank_remote(hits: DataFrame, query: str, limit: int, symbol_names: DataFrame | None = None, semantic: str = "score") -> DataFrame:
    """Hits of a remote store (id, path, text, score): BM25 over the hits alone, no feedback or suppression."""
    terms = lexical.query_terms(hits.sparkSession, query)
    scored = lexical.score(hits.withColumnRenamed(semantic, "semantic"), lexical.boosted_fields(F.col("text"), F.col("path"), F.col("symbols") if "symbols" in hits.columns else None), terms)
    scored = scored.withColumn("score", rank.fuse(F.col("semantic"), F.least(F.lit(1.0), F.col("bm25") / 10)))
    words = query.lower().split()
    if symbol_names is not None and words:
        known = {r[0] for r in symbol_names.where(F.col("name").isin(words)).select("name").distinct().collect()}
        for w in words:
            if w in known:
                scored = scored.withColumn("score", F.when(F.contains(F.lower("text"), F.lit(w)), F.col("score") * SYMBOL_HIT_BOOST).otherwise(F.col("score")))
    return rank.top(scored.withColumn("score", F.col("score") * paths.priority(F.col("path"))), limit, ties=("path", "id"))


def remote_fetch_size(limit: int) -> int:
    return max(REMOTE_OVERSAMPLE * limit, REMOTE_LEAST)
