"""Personal data: patterns propose spans, checksums confirm them, context words adjust scores (operator 3).

All of it is column expressions. A pattern's matches come from ``regexp_extract_all`` and the text between
them from ``split`` with the same pattern; running lengths of the two give positions in code points. The patterns
are possessive and anchored at the start of a run, running lengths are summed in groups and context is cut from pieces of the
text, so that very long texts, of one character class or full of matches, cost linear time.

Kinds ``email``, ``ip``, ``card`` (Luhn) and ``phone`` are always reported; ``iban`` (mod-97) and ``ssn`` need a
score of at least MIN_SCORE, to which words nearby contribute. Null text counts as empty: no spans. Repeated
rows are scanned row by row; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SCORE = 0.5
NEAR = 40
FAN, PIECE = 16, 512
LOCAL = r"[A-Za-z0-9._%+-]"

# kind: (pattern, cheap test that a text may have one, score, words that speak for it)
KINDS = {
    "email": (rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, "ip|address|host|server"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None, 0.7, "card|credit|visa|payment|karte|carte|tarjeta"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, "phone|call|tel|mobile|fax"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", None, 0.8, "iban|account|bank|konto|compte|cuenta"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3, "ssn|social|security|tax"),
}
BASE = ("email", "ip", "card", "phone")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string has a right Luhn check digit."""
    places = F.split(F.reverse(digits), "")
    doubled = F.transform(places, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + F.coalesce(d, F.lit(0))) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number has right check digits: letters count from 10, the first four characters go last."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.split(F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4)), "")

    def step(rest: Column, c: Column) -> Column:
        letter = c.rlike("[A-Z]")
        return F.when(letter, (rest * 100 + F.ascii(c) - 55) % 97).when(c != "", (rest * 10 + F.ascii(c) - 48) % 97).otherwise(rest).cast("int")

    return F.aggregate(moved, F.lit(0), step) == 1


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9]|)"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        digits = _digits(value)
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        return mod97(value)
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sums_before(numbers: Column, levels: int = 3) -> Column:
    """For each number of an array the sum of those before it; FAN at a time, so that no array grows step by step.

    An array of sums of FAN numbers is shorter by that factor, and its own sums before are found likewise.
    """
    total = lambda start, stop: F.when(stop > start, F.aggregate(F.sequence(start, stop - 1), F.lit(0).cast("bigint"), lambda s, j: s + F.get(numbers, j))).otherwise(0)
    places = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    n = F.size(numbers)
    if not levels:
        return F.transform(places(n), lambda i: total(F.lit(0), i))
    groups = F.ceil(n / FAN).cast("int")
    sums = F.transform(places(groups), lambda g: total(g * FAN, F.least(g * FAN + FAN, n)))
    before = _let(sums, lambda of: _sums_before(of, levels - 1))
    return _let(before, lambda heads: F.transform(places(n), lambda i: F.get(heads, F.floor(i / FAN).cast("int")) + total(F.floor(i / FAN).cast("int") * FAN, i)))


def _positions(matches: Column, between: Column) -> Column:
    """(``start``, ``value``) of each match: what stands before it is text and earlier matches."""

    def placed(gaps: Column, values: Column) -> Column:
        lengths = F.transform(values, lambda v, i: (F.char_length(v) + F.char_length(F.get(gaps, i + 1))).cast("bigint"))
        first = F.char_length(F.get(gaps, F.lit(0)))
        starts = _let(lengths, lambda of: _sums_before(of))
        return F.zip_with(values, starts, lambda v, s: F.struct((s + first).cast("bigint").alias("start"), v.alias("value")))

    return _let(between, lambda gaps: _let(matches, lambda values: placed(gaps, values)))


def _around(pieces: Column, start: Column, stop: Column) -> Column:
    """Characters ``start`` to ``stop`` of a text cut into pieces of PIECE characters; the text itself is not read from its beginning."""
    first = F.floor(start / PIECE).cast("int")
    some = F.transform(F.sequence(first, F.greatest(first, F.floor((stop - 1) / PIECE).cast("int"))), lambda i: F.coalesce(F.get(pieces, i), F.lit("")))
    return F.substring(F.array_join(some, ""), (start - first * PIECE + 1).cast("int"), (stop - start).cast("int"))


def spans_of(text: Column, kind: str) -> Column:
    """array<struct<kind, start, end, score>> of one kind, in order."""
    pattern, needs, score, words = KINDS[kind]
    none = F.array().cast("array<string>")
    may = F.contains(text, F.lit(needs)) if needs else text.rlike("[0-9]{2}" if kind == "iban" else "[0-9][ -]?[0-9]")
    found = F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    between = F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(none)
    valid = F.filter(_positions(found, between), lambda m: _valid(kind, m["value"]))

    def scored(pieces: Column, m: Column) -> Column:
        around = _around(pieces, F.greatest(m["start"] - NEAR, F.lit(0)), m["start"] + F.char_length(m["value"]) + NEAR)
        near = F.when(F.lower(around).rlike(rf"\b(?:{words})"), 0.3).otherwise(0.0)
        return F.struct(
            F.lit(kind).alias("kind"), m["start"].alias("start"), (m["start"] + F.char_length(m["value"])).alias("end"),
            F.least(F.lit(score) + near, F.lit(1.0)).alias("score"),
        )

    pieces = F.when(F.size(found) > 0, F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))).otherwise(none)
    out = _let(pieces, lambda cut: F.transform(valid, lambda m: scored(cut, m)))
    return out if kind in BASE else F.filter(out, lambda m: m["score"] >= MIN_SCORE)


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``spans_<kind>`` for every kind."""
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return whole.select("doc_id", "text", *[spans_of(F.col("text"), kind).alias(f"spans_{kind}") for kind in KINDS])


def masked(found: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` of ``personal_data`` rows with every span replaced by its kind; of overlapping spans the earlier one counts."""
    every = F.array_sort(F.concat(*[F.transform(f"spans_{k}", lambda s: F.struct(s["start"], s["end"], s["kind"])) for k in KINDS]))
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fresh = x["start"] >= s["at"]
        before = F.substring(F.col("text"), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        return F.struct(
            F.when(fresh, x["end"]).otherwise(s["at"]).alias("at"),
            F.when(fresh, F.concat(s["out"], before, F.lit("<"), x["kind"], F.lit(">"))).otherwise(s["out"]).alias("out"),
        )

    rest = F.aggregate(every, begin, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), F.lit(2147483647))))
    return found.select("doc_id", rest.alias("text"))


def pii_query(docs: DataFrame) -> DataFrame:
    found = personal_data(docs)

    def texts(kinds) -> Column:
        named = F.concat(*[F.col(f"spans_{k}") for k in kinds])
        return F.array_join(F.transform(named, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id",
        *[F.size(f"spans_{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(texts(BASE).cast("binary"), 256).alias("base_sha256"),
        texts(KINDS).alias("spans"),
    )
