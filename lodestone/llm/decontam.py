"""Benchmark decontamination: edit distance by CGK embedding and bit-sampling LSH.

Words are the symbols.  CGK's random walk embeds a sequence of n words in one of
3n: at each step it writes the current word, and a random bit, drawn for this
step and word, says whether to go on to the next one; words past the end are a
pad symbol.  Few edits leave few positions different.  Each of ``repeats`` walks
samples ``bits`` positions as a hash key.  Windows of a document that are as
long as an item look up the item keys of that length; a collision in any walk is
a candidate, and the exact edit distance against the text around it decides:
at most ``1 - similarity`` edits a word.  Every place is reported: places of one item are
disjoint, and where candidates overlap the one with fewest edits is taken, then what is left on
either side of it is searched again.

Windows that cannot be that near are not embedded: n words with at most e edits
keep an unbroken run of n // (e + 1) words, so a window without such a run of any
item's words at about its place is out.  This screen is exact.

Items are a stated query set and come in blocks of at most ``block`` items, each
of which is matched against all rows in a pass of its own.

Defined results: a null or empty text matches nothing; items without words match
nothing; items of few words must match exactly; rows that repeat are all
reported; null ids are reported with a null id; a very long text is searched whole, in time in proportion to
its length; an empty table gives an empty
result; columns beyond the named ones are ignored by ``find`` and carried through by ``keep_clean``, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import mix

U = np.uint64
_WORD = re.compile(r"\w+")
PAD = -1


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def edits_allowed(n: int, similarity: float) -> int:
    return int(n * (1 - similarity) + 1e-9)


def embed(symbols: np.ndarray, n: int, picks: np.ndarray, bits_of: np.ndarray) -> np.ndarray:
    """What each walk writes at its sampled steps: walks x rows x bits, for rows of n symbols.

    ``picks`` has a row of steps for each walk; all walks advance together.
    """
    walks, bits = picks.shape
    padded = np.hstack([symbols, np.full((len(symbols), 1), PAD)])
    rows = np.arange(len(symbols))
    at = np.zeros((walks, len(symbols)), np.int64)
    out = np.empty((walks, len(symbols), bits), np.int64)
    due: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for w in range(walks):
        for k in range(bits):
            due[int(picks[w, k])].append((w, k))
    lead = (np.arange(1, walks + 1, dtype=U) * U(131))[:, None]
    scrambled = None
    walk = np.arange(walks)[:, None]
    for step in range(max(due) + 1):
        here = padded[rows, at]
        for w, k in due.get(step, ()):
            out[w, :, k] = here[w]
        if step % 64 == 0:
            scrambled = mix(bits_of + (lead + U(step // 64)) * U(0x9E3779B97F4A7C15))
        go = (scrambled[walk, here] >> U(step % 64)) & U(1)
        at = np.minimum(at + go.astype(np.int64), n)
    return out


@dataclass
class Index:
    """The lookup tables of one block of items."""

    similarity: float
    repeats: int
    bits: int
    seed: int = 17
    ids: list = field(default_factory=list)
    items: list[np.ndarray] = field(default_factory=list)
    vocab: dict[str, int] = field(default_factory=dict)

    def add(self, item_id: object, text: str | None) -> None:
        found = words(text)
        if found:
            self.ids.append(item_id)
            self.items.append(np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in found], np.int64))

    def finish(self) -> Index:
        lengths = sorted({len(x) for x in self.items})
        self.runs = {n: max(1, n // (edits_allowed(n, self.similarity) + 1)) for n in lengths}
        grams: dict[int, dict[int, set[tuple[int, int]]]] = defaultdict(lambda: defaultdict(set))
        for x in self.items:
            run = self.runs[len(x)]
            for p, g in enumerate(_grams(x, run).tolist()):
                grams[run][g].add((len(x), p))
        self.screen = {}
        for run, found in grams.items():
            keys = np.array(sorted(found), np.int64)
            self.screen[run] = keys, [sorted(found[g]) for g in keys.tolist()]
        # the last row belongs to the pad symbol -1, row 0 to words that no item has
        self.bits_of = mix(np.arange(len(self.vocab) + 2, dtype=U) * U(0xD6E8FEB86659FD93) + U(self.seed))
        rng = np.random.default_rng(self.seed)
        self.picks = {n: np.array([np.sort(rng.choice(max(2 * n, self.bits), self.bits, replace=False)) for _ in range(self.repeats)]) for n in lengths}
        self.keys: dict[tuple, list[int]] = defaultdict(list)
        for n in lengths:
            mine = [i for i, x in enumerate(self.items) if len(x) == n]
            block = np.array([self.items[i] for i in mine])
            for r, keys in enumerate(embed(block, n, self.picks[n], self.bits_of).tolist()):
                for i, key in zip(mine, keys, strict=True):
                    self.keys[n, r, *key].append(i)
        return self

    def windows(self, ids: np.ndarray) -> dict[int, set[int]]:
        """Item length -> starts of the windows that the run screen lets through."""
        starts: dict[int, set[int]] = defaultdict(set)
        for run, (keys, places) in self.screen.items():
            if len(ids) < run:
                continue
            h = _grams(ids, run)
            slot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            for p in np.flatnonzero(keys[slot] == h).tolist():
                for n, q in places[slot[p]]:
                    e = edits_allowed(n, self.similarity)
                    starts[n].update(range(max(0, p - q - e), min(p - q + e, len(ids) - 1) + 1))
        return starts

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(row, item, edits, first word, word after the last) of each place near an item."""
        get = self.vocab.get
        rows: dict[int, np.ndarray] = {}
        wanted: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for r, text in enumerate(texts):
            ids = np.fromiter((get(w, 0) for w in words(text)), np.int64)
            for n, starts in self.windows(ids).items():
                rows[r] = ids
                wanted[n] += [(r, s) for s in sorted(starts)]
        found = []
        for n, windows in wanted.items():
            near: dict[tuple[int, int], set[int]] = defaultdict(set)
            for at in range(0, len(windows), 4096):
                self._collide(n, windows[at : at + 4096], rows, near)
            e = edits_allowed(n, self.similarity)
            found += [(r, i, *place) for (r, i), starts in near.items() for place in places(self.items[i], rows[r], sorted(starts), e)]
        return sorted(found)

    def _collide(self, n: int, windows: list[tuple[int, int]], rows: dict[int, np.ndarray], near: dict[tuple[int, int], set[int]]) -> None:
        """Add the starts of the windows that share a key with an item to ``near`` (row, item)."""
        block = np.full((len(windows), n), PAD, np.int64)
        for k, (r, s) in enumerate(windows):
            part = rows[r][s : s + n]
            block[k, : len(part)] = part
        for walk, keys in enumerate(embed(block, n, self.picks[n], self.bits_of).tolist()):
            for (r, s), key in zip(windows, keys, strict=True):
                for i in self.keys.get((n, walk, *key), ()):
                    near[r, i].add(s)


def _grams(ids: np.ndarray, run: int) -> np.ndarray:
    """A 62-bit hash of each run of symbols."""
    m = max(0, len(ids) - run + 1)
    h = np.zeros(m, U)
    for k in range(run):
        h = h * U(0x5851F42D4C957F2D) + ids[k : m + k].astype(U)
    return (mix(h) >> U(2)).astype(np.int64)


def _nearest(item: np.ndarray, ids: np.ndarray, starts: list[int], lo: int, hi: int, e: int) -> tuple[int, int, int] | None:
    """Edits, start and end of the best stretch of ``ids[lo:hi]``, if near enough."""
    n = len(item)
    if hi - lo < n - e:
        return None
    for s in starts[bisect_left(starts, lo) : bisect_right(starts, hi - n)]:
        if np.array_equal(ids[s : s + n], item):
            return 0, s, s + n
    d, x, y = best_place(item, ids[lo:hi])
    return (d, lo + x, lo + y) if d <= e else None


def _inside(item: np.ndarray, ids: np.ndarray, starts: list[int], lo: int, hi: int, e: int) -> Iterator[tuple[int, int, int]]:
    best = _nearest(item, ids, starts, lo, hi, e)
    if best is not None:
        yield from _inside(item, ids, starts, lo, best[1], e)
        yield best
        yield from _inside(item, ids, starts, best[2], hi, e)


def places(item: np.ndarray, ids: np.ndarray, starts: list[int], e: int) -> list[tuple[int, int, int]]:
    """Edits, first word and word after the last of the disjoint places near ``item``, found from
    the candidates' sorted ``starts``: each is a place's start but for ``e`` words.

    A step looks at some ``n + 4 e`` words, or as many more as a nearer place overlaps them.
    """
    n, found, free, k = len(item), [], 0, 0
    while k < len(starts):
        s = starts[k]
        lo, hi = max(free, s - e), min(len(ids), s + n + 3 * e)
        best = _nearest(item, ids, starts, lo, hi, e)
        if best is None:
            # nothing starts up to 2 e words behind s
            k = bisect_right(starts, s + e)
            continue
        while best[0] and hi < min(len(ids), best[2] + n + e):
            hi = min(len(ids), best[2] + n + e)
            wider = _nearest(item, ids, starts, lo, hi, e)
            if wider[0] >= best[0]:
                break
            best = wider
        found += [*_inside(item, ids, starts, lo, best[1], e), best]
        free = best[2]
        k = max(k + 1, bisect_left(starts, free - e))
    return found


def best_place(item: np.ndarray, ids: np.ndarray) -> tuple[int, int, int]:
    """The least edit distance of ``item`` to a stretch of ``ids``, and that stretch."""
    width = len(ids) + 1
    j = np.arange(width)
    cost, start = np.zeros(width, np.int64), j.copy()
    for k, v in enumerate(item.tolist(), 1):
        up, diag = cost + 1, np.empty(width, np.int64)
        diag[0] = k
        diag[1:] = cost[:-1] + (ids != v)
        best = np.minimum(up, diag)
        origin = np.where(diag <= up, np.concatenate([[0], start[:-1]]), start)
        # moving right costs one a word: a running minimum of best - j
        shifted = best - j
        run = np.minimum.accumulate(shifted)
        source = np.maximum.accumulate(np.where(shifted == run, j, 0))
        cost, start = run + j, origin[source]
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), end


def blocks(items: DataFrame, block: int, similarity: float, repeats: int, bits: int, item_id: str, text: str) -> Iterator[Index]:
    index = None
    for row in items.select(item_id, text).orderBy(item_id).toLocalIterator():
        if index is None or len(index.items) >= block:
            if index is not None:
                yield index.finish()
            index = Index(similarity, repeats, bits)
        index.add(row[0], row[1])
    if index is not None and index.items:
        yield index.finish()


def _matched(index: Index, texts: pa.Array, chunk: int = 256) -> Iterator[tuple[int, int, int, int, int]]:
    for at in range(0, len(texts), chunk):
        for r, *rest in index.matches(texts.slice(at, chunk).to_pylist()):
            yield at + r, *rest


def _search(index: Index, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, items, edits, first, stop = [], [], [], [], []
            for r, i, d, a, b in _matched(index, batch.column("__text")):
                rows.append(r)
                items.append(index.ids[i])
                edits.append((d, len(index.items[i])))
                first.append(a)
                stop.append(b)
            taken = pa.array(rows, pa.int64())
            i64 = pa.int64()
            yield pa.record_batch(
                [*(batch.column(c).take(taken) for c in keep), pa.array([str(i) for i in items], pa.string()), pa.array([d for d, _ in edits], i64), pa.array([n for _, n in edits], i64), pa.array(first, i64), pa.array(stop, i64)],
                names=[*keep, "__item", "edits", "n_words", "first_word", "stop_word"],
            )

    return run


def find(docs: DataFrame, items: DataFrame, similarity: float = 0.8, repeats: int = 32, bits: int = 3, block: int = 5000, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per place: doc_id, item_id, edits, n_words, first_word, stop_word."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    i64 = T.LongType()
    schema = T.StructType([src.schema["doc_id"], T.StructField("__item", T.StringType()), *(T.StructField(c, i64) for c in ("edits", "n_words", "first_word", "stop_word"))])
    out: DataFrame | None = None
    for index in blocks(items, block, similarity, repeats, bits, item_id, item_text):
        part = src.mapInArrow(_search(index, ["doc_id"]), schema)
        out = part if out is None else out.unionByName(part)
    out = docs.sparkSession.createDataFrame([], schema) if out is None else out
    return out.withColumn("item_id", F.col("__item").cast(items.schema[item_id].dataType)).select("doc_id", "item_id", "edits", "n_words", "first_word", "stop_word")


def pairs(found: DataFrame) -> DataFrame:
    """One row per document and item: the nearest place and the number of places."""
    return found.groupBy("doc_id", "item_id").agg(
        F.min(F.struct("edits", "first_word", "stop_word", "n_words")).alias("b"), F.count(F.lit(1)).alias("places")
    ).select("doc_id", "item_id", "b.edits", "b.n_words", "b.first_word", "b.stop_word", "places")


def keep_clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no item; one pass a block, no shuffle."""
    names = docs.columns
    out = docs
    for index in blocks(items, options.get("block", 5000), options.get("similarity", 0.8), options.get("repeats", 32), options.get("bits", 3), "item_id", "text"):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[r for r, *_ in _matched(index, batch.column(text))]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out.select(*names)
