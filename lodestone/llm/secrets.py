"""Secret scanning with corpus-wide ownership frequency.

Patterns propose candidate credentials in each whole text.  Every candidate is
hashed, and the corpus is aggregated by hash into the number of distinct
repositories and owners that carry it.  A value that ``example_owners`` owners carry, or
that two owners carry in ``example_repos`` repositories, is a
copied example; a random-looking value that one owner carries is live-looking.
Only DataFrame expressions run; the counts are pre-combined by (hash, owner, repository),
then by (hash, owner) and then by hash, so that no list of owners is ever held.
A repository's owner is what its name has before ``/`` (a name without one is its own
owner) or a given column.

Defined results: a null text counts as empty (no spans); a very long text takes time in
proportion to its length and matches; a null repository or
owner counts as one unnamed repository; repeated rows each get their own result
row; an empty table gives an empty result; columns beyond the named ones are
ignored by ``scan`` and carried through by ``redact``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import count_kind, cut, fresh, listed, matches, without


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORD = "|".join(
    [_either("password"), _either("passwd"), _either("secret"), _either("token"), _either("api") + "_?" + _either("key")]
)
#: kind, Java pattern, group that holds the value, least length of the value
BASE = [
    ("assign", rf"""({_KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: kinds that this operator adds to the base ones
ADDED = [
    ("forge", r"gh[opsu]_[A-Za-z0-9]{20,}", 0, 24),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 20),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20),
]
BASE_KINDS = [k for k, *_ in BASE]


def spans(text: Column) -> tuple[Column, Column]:
    """(base spans, all spans), each sorted by start and then kind."""
    text = F.coalesce(text, F.lit(""))

    def at_least(n: int):
        return lambda s: F.length(s["value"]) >= n

    def of(rules: list, first: int) -> list[Column]:
        return [F.filter(matches(text, rx, kind, first + n, group), at_least(least)) for n, (kind, rx, group, least) in enumerate(rules)]

    return F.array_sort(F.concat(*of(BASE, 0))), F.array_sort(F.concat(*of(ADDED, len(BASE))))


def looks_random(value: Column) -> Column:
    """At least 16 characters, with digits and letters, and 8 or more distinct ones."""
    return (
        (F.length(value) >= 16)
        & F.regexp_like(value, F.lit("[0-9]"))
        & F.regexp_like(value, F.lit("[A-Za-z]"))
        & (F.size(F.array_distinct(F.split(value, ""))) >= 8)
    )


def candidates(docs: DataFrame, text: str = "text", repo: str = "source", owner: Column | None = None) -> DataFrame:
    """One row per input row: its spans, repository, owner and a row number."""
    owner = F.split(F.col(repo), "/")[0] if owner is None else owner
    base, more = spans(F.col(text))
    return (
        docs.withColumns({"__base": base, "__more": more})
        .withColumn("__all", F.array_sort(F.concat("__base", "__more")))
        .withColumns(
            {
                "__repo": F.coalesce(F.col(repo), F.lit("")),
                "__owner": F.coalesce(owner, F.lit("")),
                "__row": F.monotonically_increasing_id(),
            }
        )
    )


def ownership(cands: DataFrame) -> DataFrame:
    """value hash -> distinct owners and repositories over the whole corpus."""
    return (
        cands.select("__repo", "__owner", F.explode("__all").alias("s"))
        .select(F.sha2("s.value", 256).alias("__hash"), "__repo", "__owner")
        .distinct()
        .groupBy("__hash", "__owner")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("__hash")
        .agg(F.count(F.lit(1)).alias("__owners"), F.sum("n").alias("__repos"))
    )


def verdict(value: Column, owners: Column, repos: Column, example_owners: int, example_repos: int) -> Column:
    return (
        F.when((owners >= example_owners) | ((owners > 1) & (repos >= example_repos)), F.lit("example"))
        .when((owners == 1) & looks_random(value), F.lit("live"))
        .otherwise(F.lit("unclear"))
    )


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repo: str = "source", example_owners: int = 3, example_repos: int = 5) -> DataFrame:
    """Every row's spans with each span's verdict (array ``found``)."""
    c = cut(
        candidates(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(repo).alias("source")))
        .drop("text", "__more"),
        "secrets",
    )
    own = ownership(c)
    exploded = c.where(F.size("__all") > 0).select("__row", F.explode("__all").alias("s"))
    judged = (
        exploded.withColumn("__hash", F.sha2("s.value", 256))
        .join(own, "__hash")
        .select(
            "__row",
            F.struct(
                "s.start", "s.k", "s.end", "s.kind", "s.value", "__owners", "__repos",
                verdict(F.col("s.value"), F.col("__owners"), F.col("__repos"), example_owners, example_repos).alias("verdict"),
            ).alias("f"),
        )
        .groupBy("__row")
        .agg(F.array_sort(F.collect_list("f")).alias("found"))
    )
    return c.join(judged, "__row", "left")


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns from ``scan``'s result."""

    def n(v: str) -> Column:
        return F.coalesce(F.size(F.filter("found", lambda f: f["verdict"] == v)), F.lit(0)).cast("bigint")

    return scanned.select(
        "doc_id",
        *[count_kind(F.col("__base"), k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(listed(F.col("__base")), 256).alias("base_sha256"),
        listed(F.col("__all")).alias("spans"),
        F.when(F.col("found").isNull(), 0).otherwise(n("live")).cast("bigint").alias("n_live"),
        F.when(F.col("found").isNull(), 0).otherwise(n("example")).cast("bigint").alias("n_example"),
        F.when(F.col("found").isNull(), 0).otherwise(n("unclear")).cast("bigint").alias("n_unclear"),
    )


def redact(docs: DataFrame, text: str = "text", repo: str = "source", example_owners: int = 3, example_repos: int = 5, mark: str = "[SECRET]") -> DataFrame:
    """All rows, with every span replaced unless its value is a copied example.

    Spans follow from the text alone and verdicts from the value, so the ranges
    to replace are found once for each distinct text and joined back by its hash.
    """
    names = docs.columns
    key, hidden = fresh("__key", *names), fresh("__hide", *names)
    c = candidates(docs.select(F.col(text).alias("text"), F.col(repo).alias("source"))).where(F.size("__all") > 0)
    c = cut(c.select(F.md5("text").alias(key), "__repo", "__owner", "__all"), "secrets")
    flat = c.select(key, F.explode("__all").alias("s")).select(key, "s.start", "s.end", "s.value", F.sha2("s.value", 256).alias("__hash"))
    hide = (
        flat.join(ownership(c), "__hash")
        .where(verdict(F.col("value"), F.col("__owners"), F.col("__repos"), example_owners, example_repos) != "example")
        .groupBy(key)
        .agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(hidden))
    )
    joined = docs.join(hide, F.md5(F.col(text)) == F.col(key), "left")
    return joined.withColumn(text, F.when(F.col(hidden).isNull(), F.col(text)).otherwise(without(F.col(text), F.col(hidden), mark))).select(*names)
