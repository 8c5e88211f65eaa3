"""Path classes, globs, metadata filters and languages."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    BINARY_EXTENSIONS, DEFAULT_IGNORE, DOC_PATHS, FILE_TYPES, GENERATED_PATHS, GRAPH_LANGUAGES, LANGUAGES, MAX_FILE_BYTES, TEST_PATHS,
)

CLASS_PATTERNS = {"generated": "|".join(GENERATED_PATHS), "test": "|".join(TEST_PATHS), "documentation": "|".join(DOC_PATHS)}


def classify(path: Column) -> Column:
    """generated, test, documentation or implementation; the first that matches."""
    out = F.lit("implementation")
    for kind in ("documentation", "test", "generated"):
        out = F.when(path.rlike("(?i)" + CLASS_PATTERNS[kind]), F.lit(kind)).otherwise(out)
    return out


def priority(path: Column) -> Column:
    kind = classify(path)
    out = F.lit(1.0)
    for name, factor in FILE_TYPES.items():
        out = F.when(kind == name, F.lit(factor)).otherwise(out)
    return out


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    """The file's name without its extension; names that begin with a dot stay whole."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def parent(path: Column) -> Column:
    """The directory of a file; empty at the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)


def glob_regex(pattern: str) -> str | None:
    """An anchored regex for a glob in which ``*`` crosses separators; None for a malformed one."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            j = i
            while j < len(pattern) and pattern[j] == "*":
                j += 1
            alone = j - i == 2 and (i == 0 or pattern[i - 1] == "/")
            if alone and pattern[j : j + 1] == "/":
                out, i = out + "(?:.*/)?", j + 1
                continue
            out, i = out + ".*", j
            continue
        if c == "?":
            out += "."
        elif c == "[":
            j = i + 1
            negated = pattern[j : j + 1] in ("!", "^") and bool(pattern[j : j + 1])
            j += negated
            end = pattern.find("]", j + 1)
            if end < 0:
                return None
            body = pattern[j:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out, i = out + ("[^" if negated else "[") + body + "]", end + 1
            continue
        elif c == "{":
            depth += 1
            out += "(?:"
        elif c == "}":
            if not depth:
                return None
            depth -= 1
            out += ")"
        elif c == "," and depth:
            out += "|"
        elif c == "\\":
            if i + 1 == len(pattern):
                return None
            i += 1
            out += re.escape(pattern[i])
        else:
            out += re.escape(c)
        i += 1
    return None if depth else f"^{out}$"


def globs_regex(patterns: list[str]) -> str | None:
    """One regex for any of the patterns; None if there is no valid one (nothing is filtered)."""
    found = [r for r in map(glob_regex, patterns) if r]
    return "(?s)" + "|".join(f"(?:{r})" for r in found) if found else None


def glob_filter(path: Column, patterns: list[str]) -> Column:
    rx = globs_regex(patterns)
    return F.lit(True) if rx is None else path.rlike(rx)


def metadata_filter(filters: list[str], path: Column, language: Column) -> Column:
    """All ``key=value`` filters; unknown keys and entries without ``=`` hold for every row."""

    def one(entry: str) -> Column:
        key, eq, value = entry.partition("=")
        if eq and key in ("lang", "language"):
            return F.lower(language) == value.lower()
        if eq and key in ("path", "file"):
            return F.contains(F.lower(path), F.lit(value.lower()))
        return F.lit(True)

    return reduce(lambda a, b: a & b, map(one, filters), F.lit(True))


def _label(path: Column, table: dict[str, str]) -> Column:
    ext = F.lower(extension(path))
    pairs = [x for label, exts in table.items() for e in exts.split() for x in (F.lit(e), F.lit(label))]
    return F.try_element_at(F.create_map(*pairs), ext)


def language(path: Column) -> Column:
    return F.coalesce(_label(path, LANGUAGES), F.lit("plain"))


def graph_language(path: Column) -> Column:
    return _label(path, GRAPH_LANGUAGES)


def default_excludes() -> list[str]:
    """Each ignore line, and two more globs for one that ends in a slash."""
    out = []
    for line in DEFAULT_IGNORE:
        out.append(line)
        bare = line.rstrip("/")
        if bare != line:
            out += [f"**/{bare}", f"{bare}/**"]
    return out


def ingestible(path: Column, length: Column) -> Column:
    """Not excluded, not binary and not too large."""
    ext = extension(path)
    return ~glob_filter(path, default_excludes()) & ~ext.isin(*BINARY_EXTENSIONS) & (F.lower(ext) != "min") & (length <= MAX_FILE_BYTES)
