"""Personal data: patterns propose spans, validators confirm them, context words score them.

Matches are found where the text is split by the pattern: pieces and matches take turns,
so their lengths give the offsets, in code points. Patterns are possessive and start
only where a run of their characters starts, which finds the same leftmost matches in
linear time and without recursion.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomwerk.llm.tables import kept

MIN_SCORE = 0.5
CONTEXT_CHARS = 48  # before a span
CONTEXT_BONUS = 0.3
SCAN = 512  # matches in a block when offsets are added up


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _count_digits(low: int, high: int) -> Callable[[Column], Column]:
    return lambda match: F.length(_digits(match)).between(low, high)


def luhn(match: Column) -> Column:
    """Every second digit from the right doubled, the digit sums added: divisible by 10."""
    digits = F.reverse(F.split(_digits(match), ""))
    value = lambda digit, n: F.when(n % 2 == 0, digit).otherwise(digit * 2 - F.when(digit > 4, 9).otherwise(0))
    total = F.aggregate(F.transform(digits, lambda d, n: value(d.cast("int"), n)), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def octets(match: Column) -> Column:
    """Every part at most 255, leading zeros allowed."""
    parts = F.transform(F.split(match, r"\."), lambda part: F.regexp_replace(part, "^0+", ""))
    return F.forall(parts, lambda part: (F.length(part) < 3) | ((F.length(part) == 3) & (part <= "255")))


def mod97(match: Column) -> Column:
    """First four characters to the end, letters as 10 to 35: the remainder by 97 is 1."""
    code = F.regexp_replace(match, " ", "")
    moved = F.split(F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4))), "")
    step = lambda rest, c: F.when(c.between("0", "9"), rest * 10 + F.ascii(c) - 48).otherwise(rest * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(moved, F.lit(0), step) == 1


def ssn_parts(match: Column) -> Column:
    """No part of zeros, and an area that is given out."""
    area = F.substr(match, F.lit(1), F.lit(3))
    return ~area.isin("000", "666") & (area < "900") & (F.substr(match, F.lit(5), F.lit(2)) != "00") & (F.substr(match, F.lit(8), F.lit(4)) != "0000")


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. ``always``: a confirmed span stays whatever its score."""

    name: str
    needs: str  # a cheap pattern that any text with a match has
    pattern: str
    confirm: Callable[[Column], Column] | None
    score: float
    context: str
    always: bool = True


KINDS = (
    Kind("email", "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         None, 0.9, "mail|contact|write"),
    Kind("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", octets, 0.7, r"\bip\b|host|address|server|login"),
    Kind("card", "[0-9]", r"[0-9](?:[\x20-]?[0-9])++", lambda m: _count_digits(12, 19)(m) & luhn(m), 0.8, "card|visa|credit|payment|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", _count_digits(9, 15), 0.6, "phone|call|tel|mobile|fax|whatsapp"),
    Kind("iban", "[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
         lambda m: F.length(F.regexp_replace(m, " ", "")).between(15, 34) & mod97(m), 0.9, "iban|account|bank|konto", False),
    Kind("ssn", "[0-9]{3}-[0-9]{2}-", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", ssn_parts, 0.3, "ssn|social|security", False),
)


def _starts(pieces: Column, matches: Column) -> Column:
    """The offset of every match, by adding up the lengths of pieces and matches before it.

    Blocks are added up first, so a text with very many matches takes about
    matches * ``SCAN`` steps, not their square.
    """
    steps = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda piece, match: F.struct(F.length(piece).alias("gap"), F.length(match).alias("long")))
    sums = lambda block, start: F.aggregate(
        block,
        F.struct(start.alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda state, step: F.struct(
            (state["at"] + step["gap"] + step["long"]).alias("at"),
            F.concat(state["starts"], F.array(state["at"] + step["gap"])).alias("starts"),
        ),
    )
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(steps) - 1, F.lit(0)), F.lit(SCAN)), lambda n: F.slice(steps, n + 1, F.lit(SCAN)))
    chained = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("starts")),
        lambda state, block: _joined(state, sums(block, state["at"])),
    )
    return F.flatten(chained["starts"])


def _joined(state: Column, block: Column) -> Column:
    return F.struct(block["at"].alias("at"), F.concat(state["starts"], F.array(block["starts"])).alias("starts"))


def find(docs: DataFrame, kinds=KINDS, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` with ``found``: an array of (start, kind, end, score, value) by start, then kind as listed.

    Offsets count code points, the end is exclusive; ``kind`` is its place in ``kinds``.
    Matches of one kind do not overlap. A null or empty text has an empty array. Other
    columns stay; one named ``found`` is replaced.
    """
    columns = kept(docs, "found")
    rows = docs.select(*columns, F.coalesce("text", F.lit("")).alias("_text"))
    rows = rows.withColumns({f"_m{n}": F.when(F.col("_text").rlike(kind.needs), F.regexp_extract_all("_text", F.lit(kind.pattern), F.lit(0))) for n, kind in enumerate(kinds)})
    spans = [_spans(F.col(f"_m{n}"), n, kind, min_score) for n, kind in enumerate(kinds)]
    rows = rows.withColumns({f"_s{n}": span for n, span in enumerate(spans)})
    return rows.select(*columns, F.array_sort(F.concat(*[F.col(f"_s{n}") for n in range(len(kinds))])).alias("found"))


def _spans(matches: Column, place: int, kind: Kind, min_score: float) -> Column:
    starts = _starts(F.split("_text", kind.pattern, -1), matches)
    confirmed = kind.confirm or (lambda match: F.lit(True))
    spans = F.filter(
        F.zip_with(starts, matches, lambda start, match: _scored(start, match, place, kind)),
        lambda span: confirmed(span["value"]) & (F.lit(kind.always) | (span["score"] >= min_score)),
    )
    return F.when(F.size(matches) > 0, spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,score:double,value:string>>"))


def _scored(start: Column, match: Column, place: int, kind: Kind) -> Column:
    low = F.greatest(start - CONTEXT_CHARS, F.lit(0))
    near = F.lower(F.substr(F.col("_text"), low + 1, start - low))
    score = F.lit(kind.score) + F.when(near.rlike(kind.context), CONTEXT_BONUS).otherwise(0.0)
    return F.struct(
        start.alias("start"), F.lit(place).alias("kind"), (start + F.length(match)).alias("end"),
        F.least(score, F.lit(1.0)).alias("score"), match.alias("value"),
    )


def written(found: Column, kinds=KINDS) -> Column:
    """kind:start:end of every span, joined by commas."""
    names = F.array(*[F.lit(kind.name) for kind in kinds])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
