"""Personal data: patterns propose spans, checksums confirm them, context scores them.

A pattern's score starts at its kind's prior.  A passed checksum (Luhn for
cards, mod-97 for IBANs) raises it, and what fails one is no span; a context word of
the kind raises it too, when it stands as a whole word (or with a final s) within the
40 characters before or after the span.  Only DataFrame expressions run and no row
is shuffled.  IBANs are taken in one run or in groups of four.

Defined results: a null text counts as empty; a very long text takes time in proportion
to its length and matches; repeated rows each give a row; an empty table gives an empty
result; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import count_kind, let, listed, matches, parts, piece

#: A run start or the end of the last match: the leftmost match begins nowhere else.
_E = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_IBAN = r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)"
BASE_KINDS = ["email", "ip", "card", "phone"]
#: kind -> (prior, gain of the checksum, gain of a context word, context words); scores in hundredths
SCORES = {
    "email": (80, 0, 15, "e-?mail|mail|contact|write|reply"),
    "ip": (50, 0, 30, "host|server|addr|address|client"),
    "card": (40, 30, 25, "card|credit|visa|pay"),
    "phone": (60, 0, 30, "phone|call|tel|mobile"),
    "iban": (50, 40, 10, "iban|bank|account|konto"),
}
#: what a context word needs around it
WORD = "[^a-z]({})s?[^a-z]"
CONTEXT = 40


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass Luhn's check."""
    d = F.reverse(digits(value))
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))),
        F.lit(0),
        lambda a, i: a
        + F.when(i % 2 == 1, F.coalesce(F.substring(d, i, F.lit(1)).try_cast("int"), F.lit(0))).otherwise(
            F.element_at(
                F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]),
                F.coalesce(F.substring(d, i, F.lit(1)).try_cast("int"), F.lit(0)) + 1,
            )
        ),
    )
    return (total % 10) == 0


def mod97(value: Column) -> Column:
    """ISO 7064 mod-97: the first four characters move to the end, letters count 10 to 35."""
    value = F.translate(value, " ", "")
    turned = F.concat(F.substring(value, F.lit(5), F.lit(64)), F.substring(value, 1, 4))
    rest = F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda a, c: F.when(c == "", a)
        .when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97)
        .otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )
    return rest == 1


def _within(rx: str, kind: str, order: int, text: Column, keep) -> Column:
    return F.filter(matches(text, rx, kind, order), keep)


def base_spans(text: Column) -> Column:
    n = lambda s: F.length(digits(s["value"]))
    octet = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(9)).try_cast("int"), F.lit(0)) <= 255)
    return F.array_sort(
        F.concat(
            matches(text, _E, "email", 0),
            _within(_IP, "ip", 1, text, lambda s: F.forall(F.split(s["value"], r"\."), octet)),
            _within(_CARD, "card", 2, text, lambda s: n(s).between(12, 19) & luhn(F.left(s["value"], F.lit(64)))),
            _within(_PHONE, "phone", 3, text, lambda s: n(s).between(9, 15)),
        )
    )


def added_spans(text: Column) -> Column:
    return _within(_IBAN, "iban", 4, text, lambda s: mod97(s["value"]))


def scored(spans: Column, text: Column) -> Column:
    """Each span's score in hundredths, in the order of the spans."""

    def nearby(m: Column, s: Column) -> Column:
        # a blank stands for the text's own start and end, and for the span
        reach = CONTEXT + 1
        before = piece(m["of"], F.greatest(s["start"] - reach, F.lit(0)), s["start"])
        after = piece(m["of"], s["end"], F.least(s["end"] + reach, m["n"]))
        first = F.when(s["start"] <= reach, F.lit(" ")).otherwise(F.lit(""))
        last = F.when(m["n"] - s["end"] <= reach, F.lit(" ")).otherwise(F.lit(""))
        return F.lower(F.concat(first, before, F.lit(" "), after, last))

    def score(s: Column, around: Column) -> Column:
        out = F.lit(0)
        for kind, (prior, check, gain, words) in SCORES.items():
            near = F.when(F.regexp_like(around, F.lit(WORD.format(words))), F.lit(gain)).otherwise(F.lit(0))
            out = F.when(s["kind"] == kind, F.lit(prior + check) + near).otherwise(out)
        return out

    whole = F.struct(parts(text).alias("of"), spans.alias("s"), F.length(text).cast("bigint").alias("n"))
    return F.when(F.size(spans) > 0, let(whole, lambda m: F.transform(m["s"], lambda s: let(nearby(m, s), lambda around: score(s, around))))).otherwise(
        F.expr("cast(array() as array<int>)")
    )


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base spans, all spans and a score in hundredths for each of all spans."""
    return (
        docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .withColumns({"base": base_spans(F.col("text")), "more": added_spans(F.col("text"))})
        .withColumn("found", F.array_sort(F.concat("base", "more")))
        .withColumn("scores", scored(F.col("found"), F.col("text")))
        .select("doc_id", "base", "found", "scores")
    )


def digest(scanned: DataFrame) -> DataFrame:
    return scanned.select(
        "doc_id",
        *[count_kind(F.col("base"), k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
        count_kind(F.col("found"), "iban").alias("n_iban"),
        F.array_join(F.transform("scores", lambda x: x.cast("string")), ",").alias("span_scores"),
        (F.aggregate("scores", F.lit(0), lambda a, x: a + x) / 100).alias("score_sum"),
    )
