"""Personal data in texts, with DataFrame functions only.

Patterns propose spans, checksums and number rules confirm them, and words shortly before a span raise its score.
"""
from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT_CHARS = 40
THRESHOLD = 0.5


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    back = F.reverse(digits)
    double = lambda i: F.substr(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + double(i) - F.when(double(i) > 9, 9).otherwise(0))
    return total % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number (country, check digits, rest) leaves 1 modulo 97, letters counting from 10."""
    turned = F.concat(F.substr(value, F.lit(5)), F.substr(value, F.lit(1), F.lit(4)))

    def step(acc: Column, i: Column) -> Column:
        code = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. ``maybe`` is a cheap test on the text; ``pattern`` never recurses on long runs."""

    name: str
    base: bool
    maybe: Callable[[Column], Column]
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    context: str


#: A match may only begin where the previous one ended or where no sign of the same run stands before it: the same
#: leftmost matches, without trying every later start of a long run. Repeats are possessive where what follows cannot
#: begin with the repeated signs, so no match changes and long runs need no stack.
_LOCAL = "[A-Za-z0-9._%+-]"
KINDS = (
    Kind("email", True, lambda t: t.contains("@"), rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda v: F.lit(True), 0.9, "mail|contact|write"),
    Kind("ip", True, lambda t: t.rlike(r"[0-9]\.[0-9]"), r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", lambda v: v.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|(?<=0))(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|(?<=0))){3}$"), 0.6, "ip|host|server|address"),
    Kind("card", True, lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"), r"[0-9](?:[\x20-]?[0-9])++", lambda v: F.length(_digits(v)).between(13, 19) & luhn(_digits(v)), 0.8, "card|visa|credit|pay"),
    Kind("phone", True, lambda t: t.contains("+"), r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: F.length(_digits(v)).between(9, 15), 0.7, "tel|phone|call|mobile|fax"),
    Kind("iban", False, lambda t: t.rlike("[A-Z]{2}[0-9]{2}"), r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", lambda v: mod97(F.replace(v, F.lit(" "), F.lit(""))), 0.8, "iban|account|bank"),
    Kind("ssn", False, lambda t: t.rlike("[0-9]-[0-9]{2}-[0-9]"), r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda v: F.lit(True), 0.4, "ssn|social security|security number"),
)


def _spans(text: Column, kind: Kind) -> Column:
    """Valid spans of one kind in text order: where a match lies follows from the lengths of the gaps around it."""
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)
    steps = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("value"), F.length(g).alias("gap")))

    def add(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        end = start + F.length(s["value"])
        one = F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), s["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["all"], F.array(one)).alias("all"))

    every = F.aggregate(steps, F.struct(F.lit(0).alias("at"), empty.alias("all")), add, lambda acc: acc["all"])
    return F.when(kind.maybe(text), F.filter(every, lambda s: kind.valid(s["value"]))).otherwise(empty)


def _scored(text: Column, spans: Column, kind: Kind) -> Column:
    """Spans with their score: the kind's own, 0.3 more (at most 1) if a context word stands shortly before."""

    def one(s: Column) -> Column:
        from_ = F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0))
        near = F.lower(F.substr(text, from_ + 1, s["start"] - from_)).rlike(rf"(?:^|[^a-z])(?:{kind.context})")
        score = F.least(F.lit(1.0), F.lit(kind.score) + F.when(near, 0.3).otherwise(0.0))
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.round(score, 2).alias("score"))

    return F.transform(spans, one)


def find(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``pii``: an array of (kind, start, end, score), by kind as listed and then by start.

    Positions are code points of the whole text, ends exclusive. Base kinds are found leftmost and non-overlapping, a
    match that fails its checksum or number rule is dropped; further kinds need a score of ``threshold`` or more. A null
    or empty text has an empty array. Rows are independent: repeated rows come back as often, nulls elsewhere pass
    through, a column named pii is replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.drop("pii").withColumns({f"__{k.name}": _spans(text, k) for k in kinds})
    parts = [_scored(text, F.col(f"__{k.name}"), k) for k in kinds]
    parts = [p if k.base else F.filter(p, lambda s: s["score"] >= threshold) for p, k in zip(parts, kinds)]
    return out.withColumn("pii", F.concat(*parts)).drop(*[f"__{k.name}" for k in kinds])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``pii`` of find) whose spans are replaced by their kind in brackets; n_chars follows the new text.

    Of overlapping spans the first wins, and what remains of the later one goes with it. A null text stays null.
    """
    text = F.col("text")
    ordered = F.array_sort(F.transform("pii", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        more = F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], more).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    changed = F.when(F.size("pii") > 0, whole).otherwise(text)
    out = docs.withColumn("text", changed).drop("pii")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def digests(found: DataFrame) -> DataFrame:
    """Counts by base kind, a checksum of the base spans and all spans as text."""
    base = [k.name for k in KINDS if k.base]
    label = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    number = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    of_base = F.array_join(F.transform(F.filter("pii", lambda s: s["kind"].isin(base)), label), ",")
    return found.select("doc_id", *[number(k) for k in base], F.sha2(of_base, 256).alias("base_sha256"), F.array_join(F.transform("pii", label), ",").alias("spans"))
