"""File and directory roll-ups of vectors, and search over them."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, vectors
from .rank import top


def mean_pool(df: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """keys, vector (component means) and n rows; whole vectors are summed, pre-combined on the map side."""
    rows = df.where(F.size(vector) > 0).select(*keys, array_to_vector(F.col(vector)).alias("__v"))
    summed = rows.groupBy(*keys).agg(Summarizer.metrics("mean", "count").summary(F.col("__v")).alias("__s"))
    return summed.select(*keys, vector_to_array("__s.mean").alias(vector), F.col("__s.count").alias("n"))


def files(chunks: DataFrame, path: str = "path", vector: str = "vector") -> DataFrame:
    """path, vector (normalised mean) and chunk_count of each file."""
    return mean_pool(chunks, [path], vector).withColumn(vector, vectors.l2_normalise(F.col(vector))).withColumnRenamed("n", "chunk_count")


def directories(file_rows: DataFrame, path: str = "path", vector: str = "vector") -> DataFrame:
    """The immediate parents of files: unweighted mean of the files' vectors; one level."""
    up = file_rows.select(paths.parent(F.col(path)).alias("__dir"), vector, "chunk_count")
    counts = up.groupBy("__dir").agg(F.count(F.lit(1)).alias("file_count"), F.sum("chunk_count").alias("chunk_count"))
    pooled = mean_pool(up.select("__dir", vector), ["__dir"], vector).drop("n")
    return pooled.join(counts, "__dir").select(F.col("__dir").alias(path), vectors.l2_normalise(F.col(vector)).alias(vector), "file_count", "chunk_count")


def search(rows: DataFrame, query: Column, limit: int, path: str = "path", vector: str = "vector") -> DataFrame:
    return top(rows.withColumn("score", vectors.cosine(F.col(vector), query)), limit, ties=(path,)).drop(vector)
