"""Embedders: the pluggable compute of the engine.

An embedder maps texts to fixed-length float vectors.  The default hashes stemmed
tokens into signed buckets: deterministic, without a model, and good for lexical
closeness only.  ``OnnxEmbedder`` loads a local model directory where one is given.
"""

from __future__ import annotations

import gzip
import json
import os
import shutil
import time
import urllib.request
from collections import OrderedDict
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .constants import VECTOR_DIM
from .functions.text import stem_word


class Embedder(Protocol):
    name: str
    dimension: int

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Signed token hashing, scaled to unit length."""

    def __init__(self, dimension: int = VECTOR_DIM):
        self.dimension, self.name = dimension, f"hashing-{dimension}"

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        v = np.zeros(self.dimension, np.float32)
        for token in _words(text):
            h = xxhash.xxh3_64_intdigest(token)
            v[h % self.dimension] += 1.0 if h >> 63 else -1.0
        n = float(np.linalg.norm(v))
        return (v / n if n > 0 else v).tolist()


def _words(text: str) -> Iterator[str]:
    word = []
    for c in text.lower() + " ":
        if c.isalnum() or c == "_":
            word.append(c)
        elif word:
            w = "".join(word)
            word = []
            if len(w.encode()) >= 2:
                yield stem_word(w)


class LengthEmbedder:
    """A test double: [byte length, 1, 0, 0, ...]."""

    def __init__(self, dimension: int = 4):
        self.dimension, self.name = dimension, "byte-length"

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [[float(len(t.encode())), 1.0] + [0.0] * (self.dimension - 2) for t in texts]


class OnnxEmbedder:
    """Mean-pooled token states of a local ONNX model (``model.onnx`` and ``tokenizer.json``)."""

    def __init__(self, folder: str, dimension: int = VECTOR_DIM, max_tokens: int = 512):
        self.folder, self.dimension, self.max_tokens, self.name = folder, dimension, max_tokens, f"onnx:{folder}"

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        session, tokenizer = _onnx(self.folder, self.max_tokens)
        found = tokenizer.encode_batch(texts)
        ids, mask = np.array([e.ids for e in found], np.int64), np.array([e.attention_mask for e in found], np.int64)
        feed = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        states = session.run(None, {i.name: feed[i.name] for i in session.get_inputs()})[0]
        pooled = (states * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)
        pooled /= np.maximum(np.linalg.norm(pooled, axis=1, keepdims=True), 1e-12)
        return pooled[:, : self.dimension].tolist()


@lru_cache(maxsize=2)
def _onnx(folder: str, max_tokens: int):
    import onnxruntime
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(f"{folder}/tokenizer.json")
    tokenizer.enable_truncation(max_tokens)
    tokenizer.enable_padding()
    return onnxruntime.InferenceSession(f"{folder}/model.onnx"), tokenizer


@dataclass(frozen=True)
class Model:
    """Where a model's files come from (remote name, local name), and its dimensions."""

    base: str
    files: tuple[tuple[str, str], ...]
    native: int
    dimension: int


_TOKENIZER = tuple((f, f) for f in ("tokenizer.json", "config.json", "special_tokens_map.json", "tokenizer_config.json"))
#: The models that can be named.
MODELS = {
    "mxbai-embed-xsmall-v1": Model("https://huggingface.co/mixedbread-ai/mxbai-embed-xsmall-v1/resolve/main", (("onnx/model.onnx", "model.onnx"), *_TOKENIZER), 384, 384),
    "jina-embeddings-v2-base-code": Model("https://huggingface.co/jinaai/jina-embeddings-v2-base-code/resolve/main", (("onnx/model_quantized.onnx", "model.onnx"), *_TOKENIZER), 768, 384),
}


def fetch(url: str, path: str, timeout: float = 300.0) -> None:
    """Download by way of a temporary name; proxies are those of the environment."""
    with urllib.request.urlopen(url, timeout=timeout) as reply, open(path + ".part", "wb") as out:
        shutil.copyfileobj(reply, out)
    os.replace(path + ".part", path)


def model_embedder(name: str, cache: str, offline: bool | None = None, get=fetch) -> OnnxEmbedder:
    """An embedder of a named model, from the folder ``cache`` (on a cluster, one that every executor sees).

    Missing files are downloaded, unless ``offline`` (or LODESTONE_OFFLINE) forbids it.
    """
    model, folder = MODELS[name], os.path.join(cache, name)
    offline = bool(os.environ.get("LODESTONE_OFFLINE")) if offline is None else offline
    missing = [(far, near) for far, near in model.files if not os.path.exists(os.path.join(folder, near))]
    if missing and offline:
        raise FileNotFoundError(f"{name} is not in {cache} and downloads are off")
    for far, near in missing:
        os.makedirs(folder, exist_ok=True)
        get(f"{model.base}/{far}", os.path.join(folder, near))
    found = OnnxEmbedder(folder, model.dimension)
    found.name = name
    return found


class HttpEmbedder:
    """A remote embedding service: requests of at most 1000 texts, optionally compressed."""

    def __init__(self, url: str, dimension: int = VECTOR_DIM, batch: int = 128, headers: dict | None = None, compress: bool = False, timeout: float = 120.0, send=None, workers: int = 1):
        self.workers = min(64, max(1, workers))
        self.url, self.dimension, self.batch, self.headers = url, dimension, min(batch, 1000), headers or {}
        self.compress, self.timeout, self.send, self.name = compress, timeout, send or _post, f"http:{url}"

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        parts = [texts[at : at + self.batch] for at in range(0, len(texts), self.batch)]
        with ThreadPoolExecutor(min(self.workers, max(1, len(parts)))) as pool:
            return [v for found in pool.map(self._request, parts) for v in found]

    def _request(self, texts: list[str]) -> list[list[float]]:
        body = json.dumps({"texts": texts, "dimension": self.dimension}).encode()
        headers = {"Content-Type": "application/json", **self.headers}
        if self.compress:
            body, headers = gzip.compress(body), {**headers, "Content-Encoding": "gzip"}
        found = json.loads(self.send(self.url, body, headers, self.timeout))["embeddings"]
        if len(found) != len(texts) or any(len(v) != self.dimension for v in found):
            raise ValueError("the service answered with another number of vectors or dimensions")
        return found


class PooledEmbedder:
    """Several embedders of one model side by side, each with every n-th batch; the order is kept."""

    def __init__(self, inner: list[Embedder], batch: int = 64):
        self.inner, self.batch = inner, batch
        self.name, self.dimension = inner[0].name, inner[0].dimension

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        parts = [texts[at : at + self.batch] for at in range(0, len(texts), self.batch)]
        with ThreadPoolExecutor(len(self.inner)) as pool:
            done = [pool.submit(lambda own, k: [own.embed_batch(p) for p in parts[k :: len(self.inner)]], e, k) for k, e in enumerate(self.inner)]
        mine = [iter(d.result()) for d in done]
        return [v for k in range(len(parts)) for v in next(mine[k % len(mine)])]


def _post(url: str, body: bytes, headers: dict, timeout: float) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as reply:
        return reply.read()


class RetryingEmbedder:
    """Another embedder with attempts and growing pauses."""

    def __init__(self, inner: Embedder, attempts: int = 3, pause: float = 0.2):
        self.inner, self.attempts, self.pause = inner, attempts, pause
        self.name, self.dimension = inner.name, inner.dimension

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        for attempt in range(1, self.attempts + 1):
            try:
                out = self.inner.embed_batch(texts)
            except Exception:
                if attempt == self.attempts:
                    raise
                time.sleep(self.pause * attempt)
                continue
            if any(len(v) != self.dimension for v in out):
                raise ValueError(f"{self.name}: expected {self.dimension} dimensions")
            return out
        raise AssertionError


class CachedEmbedder:
    """Keeps the latest vectors by exact text, up to ``capacity``."""

    def __init__(self, inner: Embedder, capacity: int = 100_000):
        self.inner, self.capacity, self.kept = inner, capacity, OrderedDict()
        self.name, self.dimension, self.computed = inner.name, inner.dimension, 0

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        new = [t for t in dict.fromkeys(texts) if t not in self.kept]
        found = dict(zip(new, self.inner.embed_batch(new), strict=True)) if new else {}
        self.computed += len(new)
        out = [found[t] if t in found else self.kept[t] for t in texts]
        for t, v in zip(texts, out, strict=True):
            self.kept[t] = v
            self.kept.move_to_end(t)
        while len(self.kept) > self.capacity:
            self.kept.popitem(last=False)
        return out


#: name -> embedder; add to it to make another model selectable
REGISTRY = {"hashing": HashingEmbedder, "byte-length": LengthEmbedder}


def estimate(text: str) -> int:
    from .constants import PUNCTUATION

    words, inside, marks = 0, False, 0
    for c in text:
        if c.isalnum() or c == "_":
            words += not inside
            inside = True
        else:
            inside = False
            marks += c in PUNCTUATION
    return max(1, words + marks)


def batch_size(requested: int | None = None, gpu: bool = False) -> int:
    return min(2048, max(16, requested)) if requested else (128 if gpu else 64)


def spread_batches(size: int, total: int, least: int = 4) -> int:
    """A batch size that leaves at least ``least`` batches where there are enough texts."""
    return size if not total or total >= size * least else max(1, min(size, -(-total // least)))


def token_budget(requested: int | None = None) -> int:
    return min(20000, max(512, requested or 6000))


def batches(texts: list[str], size: int, budget: int) -> Iterator[list[str]]:
    """Consecutive texts, at most ``size`` and about ``budget`` tokens a batch."""
    held, tokens = [], 0
    for t in texts:
        n = estimate(t)
        if held and (len(held) >= size or tokens + n > budget):
            yield held
            held, tokens = [], 0
        held.append(t)
        tokens += n
    if held:
        yield held


def embed_column(embedder: Embedder, size: int = 64, budget: int = 6000):
    """An iterator Pandas UDF: one embedder a worker, batches by count and tokens."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out = [v for b in batches([t or "" for t in s], size, budget) for v in embedder.embed_batch(b)]
            yield pd.Series(out, index=s.index, dtype=object)

    return run


def embed_chunks(chunks: DataFrame, embedder: Embedder, cache: DataFrame | None = None, text: str = "text", key: str = "hash", size: int = 64) -> DataFrame:
    """chunks with ``vector``: cached where the hash is known, else computed once per distinct hash."""
    todo = chunks if cache is None else chunks.join(cache.select(key), key, "left_anti")
    fresh = todo.select(key, text).dropDuplicates([key]).select(key, embed_column(embedder, size)(F.col(text)).alias("vector"))
    known = fresh if cache is None else fresh.unionByName(cache.select(key, "vector").dropDuplicates([key]))
    return chunks.join(known, key, "left")
