"""BM25 and field-boosted BM25.

Two physical forms give the same scores.  ``score`` tokenises the rows at hand and
keeps only the query's terms: one narrow pass, and one aggregate of a handful of
numbers.  ``postings`` is the persisted form: (chunk, length, term, weight) sorted by term,
so that a query reads its own terms' row groups.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BM25_B, BM25_K1, CONTENT_BOOST, FILENAME_BOOST, PATH_BOOST, SYMBOL_BOOST
from ..functions import paths, text


class Field(NamedTuple):
    """A string whose tokens (or their stems) count with a boost."""

    content: Column
    boost: float
    stemmed: bool

    def terms(self) -> Column:
        return (text.tokenize_stemmed if self.stemmed else text.tokenize)(self.content)

    def length(self) -> Column:
        return text.token_count(self.content)

    def only(self, terms: list[str]) -> Column:
        """The field's terms that begin like one of ``terms``: a stem begins its word."""
        found = text.tokens_like(self.content, terms)
        return F.transform(found, text.stem) if self.stemmed else found


def plain_field(content: Column) -> list[Field]:
    return [Field(F.coalesce(content, F.lit("")), 1.0, False)]


def boosted_fields(content: Column, path: Column, symbols: Column | None = None) -> list[Field]:
    """Stemmed tokens of the content, path, file stem and symbols, with their boosts."""
    parts = [(content, CONTENT_BOOST), (path, PATH_BOOST), (paths.file_stem(path), FILENAME_BOOST)]
    if symbols is not None:
        parts.append((F.array_join(symbols, " "), SYMBOL_BOOST))
    return [Field(F.coalesce(c, F.lit("")), boost, True) for c, boost in parts]


def query_terms(spark, query: str, stemmed: bool = True) -> Counter:
    """The query's tokens with their multiplicity, by the same expressions as the documents."""
    row = spark.range(1).select((text.tokenize_stemmed if stemmed else text.tokenize)(F.lit(query)).alias("t")).first()
    return Counter(row["t"])


def idf(n: Column, df: Column) -> Column:
    return F.ln((n - df + 0.5) / (df + 0.5) + 1.0)


def saturated(tf: Column, dl: Column, avg: Column) -> Column:
    return tf * (BM25_K1 + 1.0) / (tf + BM25_K1 * (1.0 - BM25_B + BM25_B * dl / avg))


def count_terms(docs: DataFrame, fields: list[Field], terms: Counter) -> DataFrame:
    """``docs`` with the weighted length and the weighted frequency of each query term: one narrow
    pass that makes no token but those that begin like a term."""
    names = sorted(terms)
    out = docs.withColumns({f"__f{k}": f.only(names) for k, f in enumerate(fields)})

    def times(term: str) -> Column:
        return reduce(lambda a, b: a + b, [F.lit(f.boost) * F.size(F.filter(f"__f{k}", lambda x: x == term)) for k, f in enumerate(fields)])

    out = out.withColumn("__dl", _length(fields)).withColumns({f"__t{i}": times(t) for i, t in enumerate(names)})
    return out.drop(*[f"__f{k}" for k in range(len(fields))])


def _length(fields: list[Field]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(f.boost) * f.length() for f in fields])


def score_counts(counted: DataFrame, terms: Counter, name: str = "bm25") -> DataFrame:
    """The result of ``count_terms`` with the score, by statistics of all its rows."""
    names = sorted(terms)
    stats = counted.agg(
        F.count(F.lit(1)).cast("double").alias("__n"),
        F.avg("__dl").alias("__avg"),
        *[F.sum((F.col(f"__t{i}") > 0).cast("double")).alias(f"__df{i}") for i in range(len(names))],
    )
    total = F.lit(0.0)
    for i, t in enumerate(names):
        part = idf(F.col("__n"), F.col(f"__df{i}")) * saturated(F.col(f"__t{i}"), F.col("__dl"), F.col("__avg"))
        total = total + F.when(F.col(f"__t{i}") > 0, terms[t] * part).otherwise(0.0)
    keep = [c for c in counted.columns if c != "__dl" and not c.startswith("__t")]
    return counted.join(F.broadcast(stats)).select(*keep, total.alias(name))


def score(docs: DataFrame, fields: list[Field], terms: Counter, name: str = "bm25") -> DataFrame:
    """``docs`` with the BM25 of the query's terms; statistics are those of ``docs``."""
    return score_counts(count_terms(docs, fields, terms), terms, name)


def postings(docs: DataFrame, key: str, fields: list[Field], *more: str) -> DataFrame:
    """(key, dl, term, tf) and ``more`` columns of the documents: boosted term frequencies, each with its document's length, so that scores need no join."""

    def weigh(w: float):
        return lambda t: F.struct(t.alias("term"), F.lit(w).alias("w"))

    weighted = F.concat(*[F.transform(f.terms(), weigh(f.boost)) for f in fields])
    # the length is a column before the terms are listed, or it would be counted again for each of them
    counted = docs.withColumn("dl", _length(fields))
    listed = counted.select(key, *more, "dl", F.explode(weighted).alias("x"))
    return listed.groupBy(key, *more, "dl", F.col("x.term").alias("term")).agg(F.sum("x.w").alias("tf"))


def lengths(docs: DataFrame, key: str, fields: list[Field]) -> DataFrame:
    """(key, dl) of every document, empty ones included."""
    return docs.select(key, _length(fields).alias("dl"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(lens: DataFrame) -> DataFrame:
    return lens.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), F.sum("dl").alias("total"))


def score_postings(posted: DataFrame, stats: DataFrame, key: str, terms: Counter, name: str = "bm25") -> DataFrame:
    """(key, score > 0) from the persisted form; only the query's postings and the one row of ``corpus_stats`` are read."""
    spark = posted.sparkSession
    q = F.broadcast(spark.createDataFrame(sorted(terms.items()), "term string, qtf bigint"))
    mine = posted.where(F.col("term").isin(list(terms)))
    df = document_frequency(mine)
    one = F.broadcast(stats.select(F.col("n").cast("double").alias("n"), "avgdl"))
    part = F.col("qtf") * idf(F.col("n"), F.col("df")) * saturated(F.col("tf"), F.col("dl"), F.col("avgdl"))
    return mine.join(F.broadcast(df), "term").join(q, "term").join(one).groupBy(key).agg(F.sum(part).alias(name)).where(F.col(name) > 0)
