"""Vector expressions.  Sums run in double precision, element by element in order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Within -1 and 1; 0 if either is the zero vector."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n)))


def l2_normalise(a: Column) -> Column:
    """Unit length, with the length computed once; a vector of (almost) no length stays as it is."""
    plain = F.transform(a, lambda x: x.cast("double"))
    return F.transform(F.array(norm(a)), lambda n: F.when(n > 1e-10, F.transform(a, lambda x: x.cast("double") / n)).otherwise(plain))[0]


def truncate(a: Column, dim: int) -> Column:
    return F.slice(a, 1, dim)


def quantise(a: Column) -> Column:
    """Sign bits in 64-bit words, lowest bit first; zero is not positive."""
    words = F.sequence(F.lit(0), F.ceil(F.size(a) / WORD).cast("int") - 1)
    signs = lambda w: F.transform(F.slice(a, w * WORD + 1, F.lit(WORD)), lambda x: F.when(x > 0, F.lit("1")).otherwise(F.lit("0")))
    return F.when(F.size(a) == 0, F.expr("cast(array() as array<bigint>)")).otherwise(
        F.transform(words, lambda w: F.conv(F.array_join(F.reverse(signs(w)), ""), 2, -10).cast("bigint"))
    )


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def literal(values) -> Column:
    """A query vector as a literal array of doubles."""
    return F.lit([float(v) for v in values]) if len(values) else F.expr("cast(array() as array<double>)")


def cosine_udf(query: list[float]):
    """Cosine against one query by Arrow batches of numpy products, for large scans."""
    q = np.asarray(query, np.float64)
    qn = float(np.linalg.norm(q))

    @F.pandas_udf("double")
    def score(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=float)
        m = np.stack(vectors.to_numpy()).astype(np.float64)
        n = np.linalg.norm(m, axis=1) * qn
        with np.errstate(invalid="ignore", divide="ignore"):
            s = np.where(n == 0, 0.0, (m @ q) / n)
        return pd.Series(np.clip(s, -1, 1))

    return score
