"""Normalisation, fusion, feedback, merging and near-duplicate suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    DUPLICATE_COSINE, LEXICAL_WEIGHT, NORMALISE_EPSILON, PRF_DOCS, PRF_MIN_COUNT, PRF_MIN_LENGTH, PRF_TERMS, SEMANTIC_WEIGHT,
)
from ..functions import text, vectors

#: results are ordered by score, then by these
TIE = ("path", "start_line", "id")


def top(df: DataFrame, k: int, score: str = "score", ties: tuple[str, ...] = TIE) -> DataFrame:
    """The k best rows; scores count to six decimals, so that ties are ties on any engine."""
    return df.orderBy(F.round(score, 6).desc(), *[F.col(c).asc() for c in ties]).limit(max(k, 1))


def normalise(df: DataFrame, score: str = "bm25", name: str = "bm25_norm") -> DataFrame:
    """Min-max over all rows; 0.5 throughout where the range is (almost) nothing."""
    bounds = F.broadcast(df.agg(F.min(score).alias("__lo"), F.max(score).alias("__hi")))
    span = F.col("__hi") - F.col("__lo")
    value = F.when(span < NORMALISE_EPSILON, F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(score) - F.col("__lo")) / span)))
    return df.join(bounds).withColumn(name, value).drop("__lo", "__hi")


def fuse(semantic: Column, lexical: Column) -> Column:
    return SEMANTIC_WEIGHT * semantic + LEXICAL_WEIGHT * lexical


def feedback_terms(best: DataFrame, query: str, text_col: str = "text") -> DataFrame:
    """(term, n) that expand the query: the most frequent terms of the best rows, then those that occur twice."""
    known = F.array_distinct(text.keywords(F.lit(query)))
    return (
        best.limit(PRF_DOCS)
        .select(F.explode(text.tokenize(F.col(text_col))).alias("term"))
        .where((F.octet_length("term") >= PRF_MIN_LENGTH) & ~F.array_contains(known, F.col("term")))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "term")
        .limit(PRF_TERMS)
        .where(F.col("n") >= PRF_MIN_COUNT)
    )


def expand(query: str, best: DataFrame, text_col: str = "text") -> str:
    """The query and its feedback terms (at most five rows come to the driver)."""
    terms = [r["term"] for r in feedback_terms(best, query, text_col).orderBy(F.desc("n"), "term").collect()]
    return " ".join([query, *terms])


def best_row(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row a key, the least by ``order``: a minimum that is pre-combined on the map side, so that
    no key's rows are ever sorted in one task."""
    whole = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(F.col(key).alias("__key")).agg(F.min_by(whole, F.struct(*order)).alias("__row")).select("__row.*")


def max_merge(first: DataFrame, second: DataFrame, key: str = "id", score: str = "score") -> DataFrame:
    """Rows of both by key; one that is in both has the better score (the first on a tie)."""
    both = first.withColumn("__pass", F.lit(0)).unionByName(second.withColumn("__pass", F.lit(1)))
    return best_row(both, key, -F.col(score), F.col("__pass")).drop("__pass")


def drop_equal_hashes(df: DataFrame, score: str = "score", hash_col: str = "hash", ties: tuple[str, ...] = TIE) -> DataFrame:
    return best_row(df, hash_col, -F.round(score, 6), *[F.col(t) for t in ties])


def suppress_near_duplicates(df: DataFrame, threshold: float = DUPLICATE_COSINE, score: str = "score", vector: str = "vector", ties: tuple[str, ...] = TIE) -> DataFrame:
    """Later rows of an equal hash go, then rows whose cosine to a kept better one exceeds ``threshold``.

    For result lists (bounded by the query's limit): the greedy pass folds one array of rows.
    """
    rows = drop_equal_hashes(df, score, ties=ties)
    if threshold >= 1:
        return rows
    cols = rows.columns
    order = F.struct((-F.round(score, 6)).alias("__o"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(ties)], F.struct(*cols).alias("__row"))
    kept = F.aggregate(
        F.col("all"),
        F.filter("all", lambda x: F.lit(False)),
        lambda acc, x: F.when(
            F.exists(acc, lambda k: vectors.cosine(k["__row"][vector], x["__row"][vector]) > threshold), acc
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return rows.agg(F.array_sort(F.collect_list(order)).alias("all")).select(F.explode(kept).alias("x")).select("x.__row.*")
