"""Personal data: expressions propose, checksums confirm, context scores.

Everything is a column expression; no Python runs on the executors. A match's place
follows from splitting the text at the same expression: the pieces between matches and the
matches themselves add up to code point positions. All steps are linear in the text and near to it in the number of matches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"
LOCAL = "A-Za-z0-9._%+-"
#: Elements that one fold appends to.
BLOCK = 128
#: Characters before a span in which context words count.
CONTEXT = 48
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


@dataclass(frozen=True)
class Kind:
    """One kind of span.

    ``pattern`` may begin only at the start of a run of its first characters, or where the
    match before ended (``\\G``): that gives the leftmost matches of the plain expression
    without trying every place of a long run. Repetitions are possessive, since nothing that follows
    could make use of a shorter one; so very long runs neither recurse nor backtrack.
    """

    name: str
    pattern: str
    hint: str  # a cheap test of the whole text
    words: str  # context words that raise the score
    score: float
    base: bool = True


KINDS = (
    Kind("email", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "mail|contact|write|kontakt|correo|courriel", 0.9),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", ".", "ip|address|host|server|adresse", 0.7),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){15,}+", "", "card|visa|credit|master|amex|karte|carte|tarjeta", 0.85),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", "tel|phone|call|mobile|fax|telefon", 0.7),
    # Beyond the base kinds: what a checksum confirms, or a checksum and a context word.
    Kind("iban", r"(?:\G|(?<![A-Za-z0-9]))[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,3})?+)(?![A-Za-z0-9])", "", "iban|account|konto|compte|cuenta|bank", 0.9, False),
    Kind("short_card", r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9]){12,14}+(?![\x20-]?[0-9])", "", "card|visa|credit|master|amex|karte|carte|tarjeta", 0.4, False),
)


def mod97(code: Column) -> Column:
    """Remainder of an IBAN-like code by 97: first four characters to the end, letters as 10 to 35."""
    turned = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97).cast("int"))


def confirmed(kind: str, found: Column) -> Column:
    """Whether a proposed match passes the checks of its kind."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return found.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "short_card":
        return F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        return mod97(F.replace(found, F.lit(" "), F.lit(""))) == 1
    return F.lit(True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though lambdas inside use it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(sizes: Column, count: Column) -> Column:
    """Sum of the numbers before each element of an array, from the lengths of ``count`` elements.

    A fold that appends copies what it has, so it runs over blocks of at most ``BLOCK`` elements, and once over their totals.
    """
    none = F.expr("cast(array() as array<int>)")

    def sums(values: Column, begin: Column) -> Column:
        step = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(values, F.struct(begin.alias("at"), none.alias("out")), step, lambda a: a["out"])

    blocks = F.transform(F.sequence(F.lit(1), count, F.lit(BLOCK)), lambda at: F.slice(sizes, at, F.least(F.lit(BLOCK), count - at + 1)))
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
    long = F.flatten(F.zip_with(blocks, sums(totals, F.lit(0)), sums))
    return F.when(count <= BLOCK, sums(sizes, F.lit(0))).otherwise(long)


def proposals(text: Column, kind: Kind, found: Column) -> Column:
    """array of (start, end, found, near) for the matches ``found`` of a kind in ``text``; near is the text before, back to the match before."""
    gaps = F.split(text, kind.pattern, -1)
    pairs = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("found"), g.alias("gap"), F.length(g).alias("before"), F.length(m).alias("size")))

    def placed(x: Column, at: Column) -> Column:
        start = at + x["before"]
        return F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["found"].alias("found"), F.right(x["gap"], F.lit(CONTEXT)).alias("near"))

    return let(pairs, lambda p: let(F.transform(p, lambda x: x["before"] + x["size"]), lambda sizes: F.zip_with(p, running(sizes, F.size(sizes)), placed)))


def context_score(kind: Kind, near: Column) -> Column:
    hit = F.lower(near).rlike(rf"(?<![a-z])(?:{kind.words})")
    return F.when(hit, F.least(F.lit(1.0), F.lit(kind.score + 0.3))).otherwise(F.lit(kind.score)).cast("double")


def matches(text: Column, kind: Kind) -> Column:
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    return F.when(text.contains(kind.hint), found).otherwise(F.expr("cast(array() as array<string>)")) if kind.hint else found


def find_spans(docs: DataFrame, text_col: str = "text", threshold: float = 0.6) -> DataFrame:
    """``docs`` with a column ``pii``: all spans by kind in the order of ``KINDS``, then start.

    Base kinds (email, ip, card, phone) stay whatever their score; others need ``threshold``. A context word
    in the characters before, back to the match of that kind before, adds 0.3 to a score of at most 1. A null text counts as
    empty and has no spans. An existing ``pii`` is replaced.
    """
    own, names = free_name("text", docs.columns), []
    for kind in KINDS:
        names.append(free_name(kind.name, [*docs.columns, own]))
    text = F.col(own)
    out = docs.withColumn(own, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    out = out.select("*", *[matches(text, k).alias(n) for k, n in zip(KINDS, names, strict=True)])

    def spans(kind: Kind, name: str) -> Column:
        scored = lambda x: F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), context_score(kind, x["near"]).alias("score"))
        good = F.transform(F.filter(proposals(text, kind, F.col(name)), lambda x: confirmed(kind.name, x["found"])), scored)
        good = good if kind.base else F.filter(good, lambda x: x["score"] >= threshold)
        return F.when(F.size(name) > 0, good).otherwise(F.expr(f"cast(array() as {SPAN})"))

    found = F.concat(*[spans(k, n) for k, n in zip(KINDS, names, strict=True)])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c != "pii"], found.alias("pii"))


def _marker(kind: Kind, threshold: float) -> Callable[[Column, Column], Column]:
    """A match with the gap before it; its kind stands for a confirmed one."""

    def piece(m: Column, g: Column) -> Column:
        good = confirmed(kind.name, m)
        if not kind.base:
            good = good & (context_score(kind, F.right(g, F.lit(CONTEXT))) >= threshold)
        return F.concat(g, F.when(good, F.lit(f"<{kind.name.upper()}>")).otherwise(m))

    return piece


def masked(docs: DataFrame, text_col: str = "text", threshold: float = 0.6) -> DataFrame:
    """``docs`` with the personal data of ``text_col`` replaced by its kind in angle brackets.

    One kind after the other, those with letters first: each replaces its confirmed matches (under the rules of
    ``find_spans``) in what the kinds before have left, so what overlaps a replaced match is searched again without it. Texts
    without matches stay as they are, null ones too.
    """
    own, out = free_name("text", docs.columns), docs
    found, gaps = free_name("found", [*docs.columns, own]), free_name("gaps", [*docs.columns, own])
    given = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    out = docs.select(*given, F.col(f"`{text_col}`").alias(own))
    for kind in sorted(KINDS, key=lambda k: ("iban", "email", "card", "short_card", "ip", "phone").index(k.name)):
        text = F.coalesce(F.col(own).cast("string"), F.lit(""))
        out = out.select(*given, own, matches(text, kind).alias(found))
        out = out.select(*given, own, found, F.when(F.size(found) > 0, F.split(text, kind.pattern, -1)).alias(gaps))

        # The gap after the last match has no match to go with.
        turned = F.concat(F.array_join(F.zip_with(F.col(found), F.slice(gaps, 1, F.size(found)), _marker(kind, threshold)), ""), F.element_at(gaps, -1))
        out = out.select(*given, F.when(F.size(found) > 0, turned).otherwise(F.col(own)).alias(own))
    return out.select(*[F.col(own).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the array."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
