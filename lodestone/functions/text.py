"""Tokens, keywords, stems and token estimates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import PUNCTUATION, STOP_WORDS, SUFFIXES

NOT_WORD = r"[^\p{IsAlphabetic}\p{N}_]"
NOT_ALNUM = r"[^\p{IsAlphabetic}\p{N}]"


def tokenize(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores of two or more bytes, in order."""
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: F.octet_length(w) >= 2)


#: a token: a run of two or more word characters, or a single one of two or more bytes
_WORD = r"\p{IsAlphabetic}\p{N}_"
_TOKEN = rf"[{_WORD}]{{2,}}|[{_WORD}&&[^\x00-\x7F]]"


def token_count(text: Column) -> Column:
    """How many tokens ``tokenize`` gives, without making them."""
    return F.regexp_count(F.lower(text), F.lit(_TOKEN))


def tokens_like(text: Column, beginnings: list[str]) -> Column:
    """The tokens that begin with any of the given strings (of word characters), without making the others."""
    if not beginnings:
        return F.expr("cast(array() as array<string>)")
    rx = rf"(?<![{_WORD}])(?:{'|'.join(sorted(beginnings))})[{_WORD}]*"
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(rx), F.lit(0)), lambda w: F.octet_length(w) >= 2)


def keywords(text: Column) -> Column:
    """Lower-case runs of letters and digits of three or more bytes that are no stop words."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(F.split(F.lower(text), NOT_ALNUM), lambda w: (F.octet_length(w) >= 3) & ~F.array_contains(stop, w))


def stem(word: Column) -> Column:
    """``word`` (lower case) without the first listed suffix that leaves more than two bytes."""
    out = word
    for s in reversed(SUFFIXES):
        cut = F.left(word, F.length(word) - len(s))
        out = F.when((F.octet_length(word) > len(s) + 2) & F.endswith(word, F.lit(s)), cut).otherwise(out)
    return out


def stem_word(word: str) -> str:
    """The same for a Python string."""
    word = word.lower()
    size = len(word.encode())
    for s in SUFFIXES:
        if size > len(s) + 2 and word.endswith(s):
            return word[: -len(s)]
    return word


def tokenize_stemmed(text: Column) -> Column:
    return F.transform(tokenize(text), stem)


def estimate_tokens(text: Column) -> Column:
    """Word runs plus listed punctuation marks, at least one."""
    marks = "[" + "".join("\\" + c for c in PUNCTUATION) + "]"
    count = F.regexp_count(text, F.lit(r"[\p{IsAlphabetic}\p{N}_]+")) + F.regexp_count(text, F.lit(marks))
    return F.greatest(F.lit(1), count)


def lines(text: Column) -> Column:
    """Lines without their ends; a last empty line does not count."""
    return let(F.split(text, r"\r?\n", -1), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def truncate_bytes(text: Column, limit: int) -> Column:
    """The longest beginning of at most ``limit`` UTF-8 bytes that ends between characters.

    A cut inside a character leaves one to three bytes of it, which decoding turns into replacement characters.
    """
    raw = F.substring(F.encode(text, "UTF-8"), 1, limit)
    tries = [F.substring(raw, 1, limit - k) for k in range(4)]
    cut = F.coalesce(*[F.try_validate_utf8(t.cast("string")) for t in tries])
    return F.when(F.octet_length(text) <= limit, text).otherwise(cut)


def truncate_ellipsis(text: Column, limit: int) -> Column:
    """At most ``limit`` bytes: a shortened text ends in an ellipsis (three bytes)."""
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(truncate_bytes(text, limit - 3), F.lit("…")))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def snippet(text: Column, full: bool = False, limit: int = 12) -> Column:
    """The text after its header comment block; its first lines unless ``full``."""

    def start(ls: Column) -> Column:
        """Lines to skip: the file line, up to the first blank line, and a context line."""
        n = F.size(ls)
        first = F.when(F.startswith(F.element_at(ls, 1), F.lit("// File:")), 1).otherwise(0)
        after = F.slice(ls, first + 1, F.greatest(n - first, F.lit(0)))
        to_blank = let(F.array_position(F.transform(after, lambda x: F.trim(x) == ""), F.lit(True)), lambda p: F.when(p > 0, first + p).otherwise(first).cast("int"))
        context = let(to_blank, lambda at: F.when(F.startswith(F.coalesce(F.get(ls, at), F.lit("")), F.lit("// Context:")), at + 1).otherwise(at))
        return let(context, lambda at: F.when((n == 0) | (at >= n), 0).otherwise(at))

    def shown(ls: Column) -> Column:
        if full:
            return let(start(ls), lambda at: F.substring(text, F.aggregate(F.slice(ls, F.lit(1), at), F.lit(1), lambda a, x: a + F.length(x) + 1), F.lit(2147483647)))
        return let(start(ls), lambda at: F.array_join(F.slice(ls, at + 1, F.lit(limit)), "\n"))

    return let(lines(text), shown)
