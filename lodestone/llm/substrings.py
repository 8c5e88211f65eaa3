"""Substring dedup by sliding sentence spans.

A sentence ends at a full stop, exclamation or question mark or line break; one of more than
``longest`` words is cut into parts, after each word that is
the least of some ``longest`` consecutive ones by hash (a sentence end comes
before all others, then the leftmost).  So no part has more words than that, and
whether a cut stands after a word depends on no word further away.  From every part on, a span is the
run that first reaches ``run`` sentence ends, however few its words, or ``words`` words, however few its
sentences; where none ends with the text, the shortest such run that does is one more.  Longer runs need no hash of
their own, as a repeated run's shorter ones repeat too and cover it.  All spans are hashed and joined over the corpus; each
occurrence but the first (least doc_id, then least text hash and offset) is removed.

With the defaults, any 50 consecutive words hold a whole span that is cut alike wherever
they stand: the cuts after words 8 to 43 depend on these 50 words alone, one is among
words 8 to 15, and the span that starts behind it ends 27 words later at most.

A span that a document holds before is marked where the document is read.  Between
documents, a pre-combined count per span tells the spans that several rows hold; only
their occurrences are compared by id and text, so a span
that every document has moves as rows, never as one group.

Defined results: words are what whitespace separates, lower-cased; what has no letter or
digit is no word and belongs to the word before it; a null text stays null and has no
spans; rows that share both id and text count as one document (equal spans of theirs are
kept), as do rows without id that share the text; a null id sorts after all others; texts
of one id count against one another by their hash; a text with fewer sentences and
words than a span needs is left as it is; a very long text is read whole, in time in proportion to its length and
cuts; an empty table gives an empty result; other columns are carried through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrowtext as at
from .common import cut, discard, fresh, without

U = np.uint64
_CODES = at.byte_codes(fold=False)
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_END = np.zeros(256, bool)
_END[list(b".!?\n")] = True
#: whitespace beyond that of arrowtext, one character for one
_BLANK = "[\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def folded(text: pa.Array) -> pa.Array:
    """Lower case and plain blanks; every character stays one character."""
    return pc.replace_substring_regex(pc.utf8_lower(text.cast(pa.large_string())), pattern=_BLANK, replacement=" ")


def _units(data: np.ndarray, offsets: np.ndarray, longest: int) -> tuple[np.ndarray, ...]:
    """Of the rows' folded bytes: row, first word, last word, start and end character of each part and whether a sentence ends there; each word's hash."""
    starts, ends, _ = at.words(data, offsets)
    marks = np.concatenate([[0], np.cumsum(_ALNUM[data])])
    real = marks[ends] > marks[starts]
    starts, ends = starts[real], ends[real]
    n = len(starts)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, np.zeros(0, bool), np.zeros(0, U)
    h = at.word_hashes(data, starts, ends, _CODES)
    row = np.searchsorted(offsets, starts, "right") - 1
    last = np.append(row[1:] != row[:-1], True)
    stops = np.where(last, offsets[row + 1], np.append(starts[1:], 0))
    tail = np.maximum.accumulate(np.where(_ALNUM[data], np.arange(len(data)), 0))[stops - 1] + 1
    breaks = np.concatenate([[0], np.cumsum(_END[data])])
    close = breaks[stops] > breaks[tail]
    width = max(1, longest)
    chosen = close | last
    if n >= width:
        key = np.where(close, U(0), U(1) << U(63)) | (h >> U(1))
        least = np.lib.stride_tricks.sliding_window_view(key, width).argmin(axis=1) + np.arange(n - width + 1)
        chosen[least[row[: n - width + 1] == row[width - 1 :]]] = True
    to = np.flatnonzero(chosen)
    first = np.append(0, to[:-1] + 1)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    base = chars[offsets[row[to]]]
    return row[to], first, to, chars[starts[first]] - base, chars[stops[to]] - base, (close | last)[to], h


def _spans(data: np.ndarray, offsets: np.ndarray, run: int, words: int, longest: int) -> tuple[np.ndarray, ...]:
    """Of the rows' folded bytes: row, hash, start and end of the span from each part, where there is one, and of those at the rows' ends."""
    row, first, to, start, end, stop, h = _units(data, offsets, longest)
    n = len(row)
    ends = np.cumsum(stop)
    before = ends - stop
    j = np.minimum(np.searchsorted(ends, before + run), np.searchsorted(to, first + words - 1))
    i = np.flatnonzero(j < n)
    i = i[row[j[i]] == row[i]]
    final = np.flatnonzero(np.append(row[1:] != row[:-1], True)) if n else i
    k = np.maximum(np.searchsorted(before, ends[final] - run, "right"), np.searchsorted(first, to[final] - words + 1, "right")) - 1
    short = (k >= 0) & (row[k] == row[final]) & (j[k] < final)
    i, j = np.concatenate([i, k[short]]), np.concatenate([j[i], final[short]])
    size = to[j] - first[i] + 1
    mult = at.mix(np.arange(1, words + longest + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
    total = size.astype(U)
    for k in range(int(size.max(initial=0))):
        more = np.flatnonzero(size > k)
        total[more] += h[first[i[more]] + k] * mult[k]
    return row[i], at.mix(total).view(np.int64), start[i], end[j]


def _bytes(text: str) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(folded(pa.array([text]))[0].as_py().encode(), np.uint8)
    return data, np.array([0, len(data)])


def units(text: str, longest: int = 8) -> list[tuple[int, int, int]]:
    """(start, end, words) of each part; together they cover the text from its first word on."""
    _, first, to, start, end, *_ = _units(*_bytes(text), longest)
    return list(zip(start.tolist(), end.tolist(), (to - first + 1).tolist(), strict=True))


def spans(text: str, run: int = 4, words: int = 20, longest: int = 8) -> list[tuple[int, int, int]]:
    """(hash, start, end) of the spans of one text."""
    _, h, start, end = _spans(*_bytes(text), run, words, longest)
    return list(zip(h.tolist(), start.tolist(), end.tolist(), strict=True))


def _emit(run: int, words: int, longest: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["__id", "__th", "__ref"]
        plain = (pa.record_batch([*(b.column(n) for n in names), folded(b.column("__text"))], names=[*names, "__text"]) for b in batches)
        for part, data, offsets in at.slices(plain, "__text"):
            row, h, start, end = _spans(data, offsets, run, words, longest)
            order = np.lexsort((h, row))
            again = np.zeros(len(h), bool)
            again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
            rows = pa.array(row, pa.int64())
            yield pa.record_batch([pa.array(h), *(part.column(n).take(rows) for n in names), pa.array(start << 32 | end), pa.array(again)], names=["h", *names, "at", "again"])

    return emit


def repeated(docs: DataFrame, run: int = 4, words: int = 20, longest: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(__id, __th, __cut): the ranges of each (id, text hash) that an earlier span holds already."""
    src = docs.select(F.col(doc_id).alias("__id"), F.xxhash64(F.col(text)).alias("__th"), F.monotonically_increasing_id().alias("__ref"), F.col(text).alias("__text"))
    i64 = T.LongType()
    schema = T.StructType([T.StructField("h", i64), src.schema["__id"], T.StructField("__th", i64), T.StructField("__ref", i64), T.StructField("at", i64), T.StructField("again", T.BooleanType())])
    occ = cut(src.mapInArrow(_emit(run, words, longest), schema), "spans")
    # a row's number stands for its id and text hash until few spans are left
    heads = occ.where("not again").select("h", "__ref", "at")
    # rows that share id and text count here as well; the comparison below keeps them
    many = heads.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    named = occ.select("__ref", "__id", "__th").distinct()
    shared = cut(heads.join(many, "h").join(named, "__ref").select("h", "__id", "__th", "at"), "shared-spans")
    # the least text hash of the least id; nulls only where no row has an id
    least = shared.groupBy("h").agg(F.min("__id").alias("first"))
    least = shared.join(least, "h").where("__id <=> first").groupBy("h", "first").agg(F.min("__th").alias("th"))
    later = shared.join(least, "h").where("not (__id <=> first and __th = th)").select("__id", "__th", "at")
    later = later.unionByName(occ.where("again").select("__id", "__th", "at"))
    span = F.struct(F.shiftright("at", 32).alias("start"), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).alias("end"))
    ranges = cut(later.groupBy("__id", "__th").agg(F.array_sort(F.collect_set(span)).alias("__cut")), "ranges")
    discard(occ, shared)
    return ranges


def remove_repeated(docs: DataFrame, run: int = 4, words: int = 20, longest: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated spans cut out of ``text``; one more column, ``__cut`` (with more
    underscores where ``docs`` has one so named), lists the ranges cut (null: none)."""
    names = docs.columns
    i, h, ranges = (fresh(n, *names) for n in ("__id", "__th", "__cut"))
    found = repeated(docs, run, words, longest, doc_id, text).toDF(i, h, ranges)
    joined = docs.join(found, F.col(doc_id).eqNullSafe(F.col(i)) & (F.xxhash64(F.col(text)) == F.col(h)), "left")
    left = F.when(F.col(ranges).isNull(), F.col(text)).otherwise(without(F.col(text), F.col(ranges)))
    return joined.withColumn(text, left).select(*[F.col(f"`{n}`") for n in names], ranges)


def digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "text", F.greatest(F.size("__cut"), F.lit(0)).cast("long").alias("n_spans"), F.length("text").cast("long").alias("n_left"))
