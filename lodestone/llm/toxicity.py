"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another; each model sees the words of a
document and the probabilities of the categories before it.  The last link is the label itself,
``toxic``.  The labels name no categories, so the earlier links learn weak labels: rows
labelled toxic that hold one of the category's seed words below.  A category with too few
positive rows predicts its prior.

Whatever a later link sees in training is out of fold.  The rows are dealt into folds; for
each fold a whole chain is fitted on the other folds - words chosen and weighed there, its own
links fed with probabilities out of its own, inner folds - and predicts the fold.
The final chain chooses its words on all rows and learns each link with these probabilities
as inputs; the threshold is set on those of the last link.

Training reads a bounded sample of labelled rows, by a hash of the id: at most ``max_rows``
rows and ``max_bytes`` of text (documented bounds; a text that does not fit into what is left is passed over).  It keeps
``n_features`` words and word beginnings, those
most tied to the label, for it or against it.  Scoring reads every whole text.  The model is a
few thousand numbers whatever the corpus.

Defined results: a null or empty text scores the priors; null labels are not
used; a label row that repeats counts once, and a document with different labels as toxic; of an id with several
texts the one of least hash trains; without labels of both kinds nothing
is rejected; very long texts are scored whole, one at a time; an empty table gives an empty result; other columns pass
through, whatever their names (where one is named like an output, the output gets more underscores).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, discard, fresh, release

#: Common English insults and threats by category, the weak labels of the chain's first links.
SEEDS = {
    "insult": "idiot moron stupid dumb fool imbecile clown loser jerk",
    "contempt": "pathetic worthless disgusting useless hopeless disgrace",
    "dehumanising": "scum trash vermin filth garbage parasite animal",
    "threat": "kill hurt destroy die attack beat shoot burn",
}
CHAIN = [*SEEDS, "toxic"]
_TOKEN = re.compile(r"[^\W\d_]{2,}")
BEGINNINGS = (4, 5, 6)


def features(text: str) -> set[str]:
    """Distinct lower-case words, and beginnings (marked ``~``) of longer ones."""
    return {f for w in set(_TOKEN.findall(text.lower())) for f in _forms(w)}


def _forms(word: str) -> list[str]:
    return [word, *(word[:n] + "~" for n in BEGINNINGS if len(word) > n)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 120) -> np.ndarray:
    """Logistic weights (the last is the intercept) by accelerated gradient descent."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(x.shape[1], x.dtype)
    prior = min(max(y.mean(), 1e-4), 1 - 1e-4)
    w[-1] = math.log(prior / (1 - prior))
    v = np.random.default_rng(7).normal(size=x.shape[1]).astype(x.dtype)
    y = y.astype(x.dtype)
    for _ in range(12):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) or 1
    rate = 1 / (0.25 * float(np.linalg.norm(x.T @ (x @ v))) + l2)
    ahead = w.copy()
    keep = np.full(len(w), l2, x.dtype)
    keep[-1] = 0
    for k in range(steps):
        new = ahead - rate * (x.T @ (_sigmoid(x @ ahead) - y) + keep * ahead)
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w


@dataclass
class Chain:
    index: dict[str, int] = field(default_factory=dict)
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: list[np.ndarray] = field(default_factory=list)
    threshold: float = 1.1
    #: columns of words met so far; emptied when large
    seen: dict[str, tuple[int, ...]] = field(default_factory=dict)
    #: the training rows' out-of-fold probabilities
    probs: np.ndarray | None = None

    def matrix(self, texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.index)))
        seen = self.seen
        if len(seen) > 300_000:
            seen.clear()
        for r, text in enumerate(texts):
            for w in set(_TOKEN.findall(text.lower())):
                cols = seen.get(w)
                if cols is None:
                    cols = seen[w] = tuple(self.index[f] for f in _forms(w) if f in self.index)
                for c in cols:
                    x[r, c] = 1
        return x * self.scale

    def proba(self, x: np.ndarray) -> np.ndarray:
        """Probability of each category, in the chain's order."""
        return _predict(self.weights, x)


def _hash(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature)


def _seeded(found: set[str]) -> list[bool]:
    return [not found.isdisjoint(words.split()) for words in SEEDS.values()]


class Sample:
    """The labelled texts as numbered features: of each row the numbers, sorted.

    A feature stands here by its hash, so that no dictionary of all words is held; features of fewer
    than three rows are left out, as no choice takes them.
    """

    def __init__(self, texts: list[str], toxic: np.ndarray) -> None:
        self.y = np.asarray(toxic, float)
        hashed, seeded = [], []
        for text in texts:
            found = features(text)
            seeded.append(_seeded(found))
            hashed.append(np.fromiter((_hash(f) for f in found), np.uint64, len(found)))
        kinds, count = np.unique(np.concatenate([*hashed, np.zeros(0, np.uint64)]), return_counts=True)
        self.hashes = kinds[count >= 3]
        self.rows = []
        for row in hashed:
            at = np.searchsorted(self.hashes, row)
            there = at < len(self.hashes)
            there[there] = self.hashes[at[there]] == row[there]
            self.rows.append(np.sort(at[there]).astype(np.int32))
        weak = np.array(seeded, float).reshape(len(self.y), len(SEEDS)) * self.y[:, None]
        self.targets = np.hstack([weak, self.y[:, None]])

    def named(self, texts: list[str], chosen: np.ndarray) -> dict[str, int]:
        """The chosen features by name, from a second pass over the texts."""
        place = {int(self.hashes[f]): k for k, f in enumerate(chosen)}
        out: dict[str, int] = {}
        for text in texts:
            if len(out) == len(place):
                break
            for f in features(text):
                k = place.get(_hash(f))
                if k is not None:
                    out[f] = k
        return out

    def choose(self, part: np.ndarray, n_features: int) -> tuple[np.ndarray, np.ndarray]:
        """The features most tied to the label among the rows ``part``, and their weights."""
        y = self.y[part] > 0
        counts = [np.bincount(np.concatenate([self.rows[r] for r in part[y == kind]] or [np.zeros(0, np.int32)]), minlength=len(self.hashes)) for kind in (True, False)]
        often = np.flatnonzero(counts[0] + counts[1] >= 3)
        hit, miss = (c[often] + 0.5 for c in counts)
        ratio = np.log((hit / (y.sum() + 1)) / (miss / ((~y).sum() + 1)))
        z = np.abs(ratio) / np.sqrt(1 / hit + 1 / miss)
        # ties by hash, so that the order of the texts does not matter
        order = np.lexsort((often, -z))[:n_features]
        return often[order], np.abs(ratio[order])

    def matrix(self, part: np.ndarray, chosen: np.ndarray, scale: np.ndarray) -> np.ndarray:
        place = np.full(len(self.hashes) + 1, -1)
        place[chosen] = np.arange(len(chosen))
        x = np.zeros((len(part), len(chosen)), np.float32)
        for k, r in enumerate(part):
            at = place[self.rows[r]]
            at = at[at >= 0]
            x[k, at] = scale[at]
        return x


def _link(x: np.ndarray, target: np.ndarray, least: int) -> np.ndarray:
    """The weights of one link; of a category with too few rows of a kind, its prior alone."""
    if min(target.sum(), len(target) - target.sum()) >= least:
        return fit_linear(x, target)
    rate = (target.sum() + 0.5) / (len(target) + 1)
    return np.append(np.zeros(x.shape[1], x.dtype), math.log(rate / (1 - rate)))


def _deal(n: int, folds: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(other rows, own rows) of each fold."""
    fold = np.arange(n) % folds
    return [(np.flatnonzero(fold != f), np.flatnonzero(fold == f)) for f in range(folds)]


def out_of_fold(data: Sample, part: np.ndarray, n_features: int, folds: tuple[int, ...], least: int) -> np.ndarray:
    """Each link's probability of the rows ``part``, by chains that have not seen the row."""
    probs = np.zeros((len(part), len(CHAIN)))
    for rest, own in _deal(len(part), folds[0]):
        chosen, scale, weights = chain(data, part[rest], n_features, folds[1:], least)
        probs[own] = _predict(weights, data.matrix(part[own], chosen, scale))
    return probs


def chain(data: Sample, part: np.ndarray, n_features: int, folds: tuple[int, ...], least: int, probs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Features, their scale and the links' weights, learned on the rows ``part`` alone.

    ``probs`` are the rows' out-of-fold probabilities.  Where they are not given and no inner folds are left,
    the links are dealt once more: each learns from the earlier links' predictions in the other half.
    """
    chosen, scale = data.choose(part, n_features)
    x, targets = data.matrix(part, chosen, scale), data.targets[part]
    if probs is None and folds:
        probs = out_of_fold(data, part, n_features, folds, least)
    if probs is None:
        probs = np.zeros((len(part), len(CHAIN)))
        for rest, own in _deal(len(part), 2):
            columns, weigh = data.choose(part[rest], n_features)
            near, far = data.matrix(part[rest], columns, weigh), data.matrix(part[own], columns, weigh)
            for k in range(len(CHAIN) - 1):
                w = _link(near, targets[rest, k], least)
                probs[own, k] = _sigmoid(far @ w[:-1] + w[-1])
    probs = probs.astype(np.float32)
    return chosen, scale, [_link(np.hstack([x, probs[:, :k]]), targets[:, k], least) for k in range(len(CHAIN))]


def _predict(weights: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(weights)))
    for k, w in enumerate(weights):
        out[:, k] = _sigmoid(np.hstack([x, out[:, :k]]) @ w[:-1] + w[-1])
    return out


def fit(texts: list[str], toxic: np.ndarray, n_features: int = 800, folds: int = 3, least: int = 8) -> Chain:
    """A chain from labelled texts."""
    y = np.asarray(toxic, float)
    if len(y) < 2 or y.min() == y.max():
        return Chain(weights=[], threshold=1.1)
    data = Sample(texts, y)
    every = np.arange(len(y))
    probs = out_of_fold(data, every, n_features, (folds,), least)
    chosen, scale, weights = chain(data, every, n_features, (), least, probs)
    return Chain(data.named(texts, chosen), scale, weights, _threshold(probs[:, -1], y), probs=probs)


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The out-of-fold cut with the fewest errors, in the middle of its gap and within 0.2 to 0.8."""
    order = np.argsort(p)
    s, t = p[order], y[order]
    errors = np.concatenate([[0], np.cumsum(t)]) + np.concatenate([np.cumsum((1 - t)[::-1])[::-1], [0]])
    edges = np.concatenate([[0.0], (s[1:] + s[:-1]) / 2, [1.0]])
    best = np.flatnonzero(errors == errors.min())
    return float(np.clip(np.median(edges[best]), 0.2, 0.8))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, max_bytes: int = 64 << 20, doc_id: str = "doc_id", text: str = "text") -> Chain:
    """Fit on a bounded sample of labelled rows, those of least hash of the id."""
    rows, pool = bounded(docs, labels, "toxic", max_rows, max_bytes, doc_id, text)
    found = rows.toArrow().sort_by("o")
    discard(pool)
    release(docs.sparkSession)
    return fit(found.column("text").to_pylist(), np.array(found.column("y").to_pylist(), float))


def _score(model: Chain, text: str, chunk: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                p = model.proba(model.matrix(pc.fill_null(part.column(text), "").to_pylist()))
                if not p.shape[1]:
                    p = np.zeros((part.num_rows, len(CHAIN)))
                more = [*(pa.array(p[:, k]) for k in range(len(CHAIN))), pa.array(p[:, -1] >= model.threshold)]
                yield pa.record_batch([*part.columns, *more], names=[*part.schema.names, *(f"__{k}__" for k in range(len(more)))])

    return run


def _outputs(names: list[str]) -> list[str]:
    return [fresh(n, *names) for n in [*(f"__p_{c}" for c in CHAIN), "__reject"]]


def score(docs: DataFrame, model: Chain, text: str = "text") -> DataFrame:
    """``docs`` with a probability for each category (``__p_<category>``) and ``__reject``."""
    kinds = [T.DoubleType()] * len(CHAIN) + [T.BooleanType()]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(_outputs(docs.columns), kinds, strict=True))])
    run = _score(model, text)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch.rename_columns(schema.names)

    return docs.mapInArrow(named, schema)


def digest(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", *[F.col(f"__p_{c}").alias(f"p_{c}") for c in CHAIN], F.col("__reject").alias("toxic"))


def keep_clean(docs: DataFrame, model: Chain, text: str = "text") -> DataFrame:
    reject = _outputs(docs.columns)[-1]
    return score(docs, model, text).where(~F.col(reject)).select(*[F.col(f"`{c}`") for c in docs.columns])
