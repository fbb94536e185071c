"""Personal data in text, with DataFrame functions only.

Regular expressions propose spans, validators confirm them (Luhn for cards, parts of at most 255 for
addresses, digit counts for phones, mod 97 for bank accounts), and words nearby raise the score.
Offsets are code points, ends exclusive.  The matches of a kind never overlap each other, so the text
between them, cut by the same expression, gives their places.

The expressions are written so that Java's matcher neither recurses nor starts again inside a run:
a run's inner characters can't begin a leftmost match unless the last match ended there (`\\G`).

Null and empty texts have no spans.  Spans of different kinds may overlap.  Repeated rows and extra
columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import free_name, query, table


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn check of a string of digits."""
    places = F.sequence(F.lit(1), F.length(digits))

    def weighed(at: Column) -> Column:
        digit = F.ascii(F.substr(digits, F.length(digits) - at + 1, F.lit(1))) - 48
        doubled = digit * 2
        return F.when(at % 2 == 1, digit).when(doubled > 9, doubled - 9).otherwise(doubled)

    return F.aggregate(places, F.lit(0), lambda total, at: total + weighed(at)) % 10 == 0


def mod97(account: Column) -> Column:
    """ISO 7064 check of an account number: the first four characters go to the end."""
    moved = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))

    def step(rest: Column, at: Column) -> Column:
        code = F.ascii(F.substr(moved, at, F.lit(1)))
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def _card(value: Column) -> Column:
    digits = _digits(value)
    return F.length(digits).between(14, 19) & luhn(digits)


def _ip(value: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return value.rlike(rf"^{part}\.{part}\.{part}\.{part}$")


def _phone(value: Column) -> Column:
    return F.length(_digits(value)).between(10, 15)


def _iban(value: Column) -> Column:
    account = F.replace(value, F.lit(" "), F.lit(""))
    return F.length(account).between(15, 34) & mod97(account)


@dataclass(frozen=True)
class Kind:
    """A kind of span: how it is proposed, confirmed and scored."""

    name: str
    test: Callable[[Column], Column]  # cheap: false for texts that can't hold one
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    context: str  # words that raise the score when near
    base: bool = True  # base spans stay whatever their score


EMAIL_CHAR = "[A-Za-z0-9._%+-]"
KINDS = (
    Kind(
        "email",
        lambda t: t.contains("@"),
        rf"(?:\G|(?<!{EMAIL_CHAR})){EMAIL_CHAR}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda v: F.lit(True),
        0.9,
        "mail|contact|write|courriel|correo",
    ),
    Kind(
        "ip",
        lambda t: t.rlike(r"[0-9]\.[0-9]"),
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        _ip,
        0.6,
        "ip|host|server|address|login",
    ),
    Kind(
        # whole chains of digits with single separators; longer and shorter ones can't be cards
        "card",
        lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){13}"),
        r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}(?![ -]?[0-9])",
        _card,
        0.8,
        "card|visa|credit|payment|carte|karte|tarjeta",
    ),
    Kind(
        "phone",
        lambda t: t.contains("+"),
        r"\+[0-9][\x20().0-9-]+[0-9]",
        _phone,
        0.7,
        "phone|tel|call|mobile|fax",
    ),
    Kind(
        "iban",
        lambda t: t.rlike(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"),
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        _iban,
        0.8,
        "iban|account|bank|konto|compte|cuenta",
        base=False,
    ),
    Kind(
        # without country code: only the words nearby make it a phone number
        "local_phone",
        lambda t: t.rlike(r"[0-9]{3}[ .-][0-9]{4}"),
        r"(?<![0-9+(.-])(?<![0-9] )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
        lambda v: F.lit(True),
        0.3,
        "phone|tel|call|mobile|fax",
        base=False,
    ),
)
LEAST_SCORE = 0.5
NEAR = 40  # code points before and after a span in which words count
NEAR_BONUS = 0.3


def _spans(text: Column, rank: int, kind: Kind) -> Column:
    """array<struct<start, rank, end, kind, value, score>> of the confirmed spans of one kind."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pieces = F.arrays_zip(matches.alias("value"), F.slice(F.split(text, kind.pattern, -1), 1, F.size(matches)).alias("gap"))
    nothing = F.expr("CAST(array() AS array<struct<start:int,end:int,value:string>>)")
    start = F.struct(F.lit(0).alias("at"), nothing.alias("found"))

    def step(so_far: Column, piece: Column) -> Column:
        value, gap = piece["value"], piece["gap"]
        begin = so_far["at"] + F.length(gap)
        end = begin + F.length(value)
        one = F.array(F.struct(begin.alias("start"), end.alias("end"), value.alias("value")))
        found = F.when(kind.valid(value), F.concat(so_far["found"], one)).otherwise(so_far["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    found = F.aggregate(pieces, start, step, lambda end: end["found"])

    def scored(span: Column) -> Column:
        begin = F.greatest(span["start"] - NEAR, F.lit(0))
        near = F.substr(text, begin + 1, span["end"] - begin + NEAR)
        bonus = F.when(near.rlike(rf"(?i)\b(?:{kind.context})"), NEAR_BONUS).otherwise(0.0)
        score = F.least(F.lit(1.0), F.lit(kind.score) + bonus)
        return F.struct(
            span["start"].alias("start"), F.lit(rank).alias("rank"), span["end"].alias("end"),
            F.lit(kind.name).alias("kind"), span["value"].alias("value"), score.alias("score"),
        )

    rows = F.transform(found, scored)
    if not kind.base:
        rows = F.filter(rows, lambda span: span["score"] >= LEAST_SCORE)
    shape = "array<struct<start:int,rank:int,end:int,kind:string,value:string,score:double>>"
    return F.when(kind.test(text), rows).otherwise(F.array().cast(shape))


def find_spans(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """`df` with the column `spans`: all spans by start, then kind as in KINDS.

    A column of that name is replaced.  One pass over the rows, without a shuffle.
    """
    whole = free_name(df, "whole_text")
    df = df.withColumn(whole, F.coalesce(F.col(text), F.lit("")))
    found = F.concat(*[_spans(F.col(whole), rank, kind) for rank, kind in enumerate(KINDS)])
    return df.withColumn(spans, F.array_sort(found)).drop(whole)


def redact(df: DataFrame, text: str = "text", out: str = "redacted") -> DataFrame:
    """`df` with the text in which every span is its kind in angle brackets.

    Of overlapping spans the one that starts first counts, then the one whose kind is listed first.
    """
    marks = free_name(df, "pii_spans")
    df = find_spans(df, text, marks)
    whole = F.coalesce(F.col(text), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def step(so_far: Column, span: Column) -> Column:
        before = F.substr(whole, so_far["at"] + 1, span["start"] - so_far["at"])
        done = F.concat(so_far["done"], before, F.lit("<"), span["kind"], F.lit(">"))
        return F.when(span["start"] < so_far["at"], so_far).otherwise(
            F.struct(span["end"].alias("at"), done.alias("done"))
        )

    clean = F.aggregate(
        F.col(marks), start, step, lambda end: F.concat(end["done"], F.substr(whole, end["at"] + 1))
    )
    return df.withColumn(out, clean).drop(marks)


def _listed(spans: Column) -> Column:
    each = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(each, ",")


@query("op9_pii")
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    spans = F.col("spans")
    base = [kind.name for kind in KINDS if kind.base]

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return docs.select(
        "doc_id",
        *[count(kind) for kind in base],
        F.sha2(_listed(F.filter(spans, lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        _listed(spans).alias("spans"),
    )
