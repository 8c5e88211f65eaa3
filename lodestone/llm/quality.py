"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  A passage is described by
the make-up of its characters, the shape and repetition of its words, and a
signed hash of its words; a learned layer encodes that, gated attention
(tanh times sigmoid) weighs the encodings, and a logistic layer scores their
weighted mean.  Only labels of whole documents train it, so that the attention
has to find the passages that decide.

Training reads a bounded sample of labelled rows, by a hash of the id: at most ``max_rows``
rows and ``max_bytes`` of text (documented bounds; a text that does not fit into what is left is passed over),
so that the passages sent to the driver are bounded too.  Scoring reads every whole text in bounded slices.  The
model is a few thousand numbers whatever the corpus.

Defined results: a null or empty text is a bag of one blank passage and is
scored; a very long text is one large bag; null labels are not used; a label row that repeats counts once, and
a document with different labels by the greatest; of an id with several texts the one of least hash trains; without
labels of both kinds the score is their mean (0.5 without any); an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrowtext as at
from .common import bounded, discard

PASSAGE = 64
HASHED = 16
_CODES = at.byte_codes(fold=True)


def _classes() -> tuple[np.ndarray, int]:
    """Byte to character class: each punctuation mark its own, then digits, upper, lower, high bytes, controls."""
    lut = np.zeros(256, np.int64)
    lut[ord("0") : ord("9") + 1], lut[ord("A") : ord("Z") + 1], lut[ord("a") : ord("z") + 1], lut[128:] = 1, 2, 3, 4
    lut[10], lut[32] = 5, 6
    rest = [b for b in range(33, 127) if not chr(b).isalnum()]
    for k, b in enumerate(rest):
        lut[b] = 7 + k
    return lut, 7 + len(rest)


_LUT, N_CLASSES = _classes()
N_FEATURES = N_CLASSES + 8 + HASHED


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, first passage of each row and the end)."""
    starts, ends, first = at.words(data, offsets)
    n_words = np.diff(first)
    n_pass = np.maximum(1, -(-n_words // PASSAGE))
    bag = np.concatenate([[0], np.cumsum(n_pass)])
    total = int(bag[-1])
    x = np.zeros((total, N_FEATURES), np.float32)
    if not len(starts):
        return x, bag
    row = np.repeat(np.arange(len(n_words)), n_words)
    own = bag[row] + (np.arange(len(starts)) - first[row]) // PASSAGE
    # bytes belong to the passage of the last word that began before them
    reach = np.diff(np.concatenate([starts, [len(data)]]))
    of_byte = np.repeat(own, reach)
    kinds = np.bincount(of_byte * N_CLASSES + _LUT[data[starts[0] :]], minlength=total * N_CLASSES).reshape(total, N_CLASSES).astype(np.float32)
    size = np.maximum(kinds.sum(axis=1, keepdims=True), 1)
    x[:, :N_CLASSES] = np.sqrt(kinds / size)
    h = at.word_hashes(data, starts, ends, _CODES)
    count = np.maximum(np.bincount(own, minlength=total), 1)
    at_end = N_CLASSES
    for lag in (1, 2, 3):
        same = np.zeros(len(h))
        same[lag:] = (h[lag:] == h[:-lag]) & (own[lag:] == own[:-lag])
        x[:, at_end] = np.bincount(own, same, total) / count
        at_end += 1
    order = np.lexsort((h, own))
    fresh = np.ones(len(h))
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (own[order][1:] != own[order][:-1])
    x[:, at_end] = np.bincount(own[order], fresh, total) / count
    lengths = (ends - starts).astype(float)
    mean = np.bincount(own, lengths, total) / count
    x[:, at_end + 1] = mean / 10
    x[:, at_end + 2] = np.sqrt(np.maximum(np.bincount(own, lengths**2, total) / count - mean**2, 0)) / 10
    x[:, at_end + 3] = count / PASSAGE
    x[:, at_end + 4] = 1
    at_end += 5
    slot = own * HASHED + (h & np.uint64(HASHED - 1)).astype(np.int64)
    sign = np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
    x[:, at_end:] = np.bincount(slot, sign, total * HASHED).reshape(total, HASHED) / count[:, None]
    return x, bag


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class AttentionMil:
    """Encoder E, gates V and U, attention w, output c; mean and spread of the inputs."""

    params: dict[str, np.ndarray]
    mean: np.ndarray
    spread: np.ndarray
    prior: float | None = None

    def forward(self, x: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
        p, first = self.params, bag[:-1]
        sizes = np.diff(bag)
        z = (x - self.mean) / self.spread
        h = np.tanh(z @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        s = (t * g) @ p["w"]
        s = s - np.repeat(np.maximum.reduceat(s, first), sizes)
        a = np.exp(s)
        a = a / np.repeat(np.add.reduceat(a, first), sizes)
        m = np.add.reduceat(h * a[:, None], first)
        return {"z": z, "h": h, "t": t, "g": g, "a": a, "m": m, "y": _sigmoid(m @ p["c"] + p["b"][0])}

    def score(self, x: np.ndarray, bag: np.ndarray) -> np.ndarray:
        return np.full(len(bag) - 1, self.prior) if self.prior is not None else self.forward(x, bag)["y"].astype(float)


def fit(x: np.ndarray, bag: np.ndarray, y: np.ndarray, width: int = 24, gate: int = 12, steps: int = 300, rate: float = 0.02, l2: float = 3e-4) -> AttentionMil:
    """Full-batch Adam on the bags' log-loss."""
    y = np.asarray(y, np.float32)
    spread = x.std(axis=0) + 0.05 if len(x) else np.ones(N_FEATURES)
    model = AttentionMil({}, x.mean(axis=0) if len(x) else np.zeros(N_FEATURES), spread)
    if not len(y) or y.min() == y.max():
        model.prior = float(y.mean()) if len(y) else 0.5
        return model
    rng = np.random.default_rng(5)
    p = model.params
    shapes = {"E": (x.shape[1], width), "e": (width,), "V": (width, gate), "U": (width, gate), "w": (gate,), "c": (width,), "b": (1,)}
    for k, s in shapes.items():
        p[k] = (rng.normal(size=s) / np.sqrt(s[0]) * (k not in "eb")).astype(np.float32)
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    sizes = np.diff(bag)
    for step in range(1, steps + 1):
        f = model.forward(x, bag)
        dy = (f["y"] - y) / len(y)
        grad = {"c": f["m"].T @ dy, "b": np.array([dy.sum()])}
        dm = np.repeat(dy[:, None] * p["c"], sizes, axis=0)
        da = (dm * f["h"]).sum(axis=1)
        ds = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, bag[:-1]), sizes))
        grad["w"] = (f["t"] * f["g"]).T @ ds
        dt, dg = ds[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), ds[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        grad["V"], grad["U"] = f["h"].T @ dt, f["h"].T @ dg
        dh = (dm * f["a"][:, None] + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        grad["E"], grad["e"] = f["z"].T @ dh, dh.sum(axis=0)
        for k in p:
            g = grad[k] + l2 * p[k] * (k not in "eb")
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.999 * m2[k] + 0.001 * g * g
            p[k] -= (rate * m1[k] / (1 - 0.9**step) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in at.slices(batches):
        x, bag = passages(data, offsets)
        flat = pa.ListArray.from_arrays(pa.array((bag * N_FEATURES).astype(np.int32)), pa.array(x.ravel()))
        yield pa.record_batch([rows.column("o"), rows.column("y"), flat], names=["o", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, max_bytes: int = 32 << 20, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> AttentionMil:
    """Fit on a bounded sample of labelled rows that are not held out, those of least hash of the id."""
    sample, pool = bounded(docs, labels.where(~held_out()), label, max_rows, max_bytes, doc_id, text)
    rows = sample.mapInArrow(_bags, "o bigint, y int, x array<float>").toArrow().sort_by("o").combine_chunks()
    discard(pool)
    if not len(rows):
        return fit(np.zeros((0, N_FEATURES), np.float32), np.zeros(1, np.int64), np.zeros(0))
    col = rows.column("x").combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    x = np.asarray(col.flatten()).reshape(-1, N_FEATURES)
    sizes = np.asarray(col.value_lengths()) // N_FEATURES
    return fit(x, np.concatenate([[0], np.cumsum(sizes)]), np.asarray(rows.column("y").to_numpy()))


def score(docs: DataFrame, model: AttentionMil, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score and n_passages of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in at.slices(batches):
            x, bag = passages(data, offsets)
            yield pa.record_batch([rows.column("doc_id"), pa.array(model.score(x, bag)), pa.array(np.diff(bag))], names=["doc_id", "score", "n_passages"])

    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([src.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("n_passages", T.LongType())])
    return src.mapInArrow(run, schema)


def digest(scored: DataFrame, threshold: float = 0.3) -> DataFrame:
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_passages")
