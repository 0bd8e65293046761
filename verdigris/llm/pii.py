"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

All of it is column expressions. A pattern runs over a text only where a cheap test says that it could match. Spark
gives the matches of a pattern and, by ``split``, the gaps between them; their lengths in code points summed up are
the places. Patterns never go back over what they have read (possessive loops, a start only where a run begins), so
that a match takes time in proportion to the text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import whole_text

#: Code points on each side of a span in which words count as near.
NEAR = 40
#: Least score of spans of the kinds that the base rules don't have.
THRESHOLD = 0.5
NEAR_BONUS = 0.3

_SPAN = "array<struct<kind:string,start:int,end:int,match:string>>"
_STATE = f"struct<at:int,found:{_SPAN}>"


@dataclass(frozen=True)
class Kind:
    """One kind of personal data. ``base`` kinds stay whatever their score."""

    name: str
    pattern: str
    hint: str  # a cheap pattern without which the text has no match
    holds: Callable[[Column], Column]
    near: str  # words that make it likelier
    prior: float
    base: bool = True
    #: For a pattern that finds only beginnings: how many code points from such a place (0-based) on belong to the span,
    #: null if none do.
    size: Callable[[Column, Column], Column] | None = None


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _between(low: int, high: int) -> Callable[[Column], Column]:
    return lambda match: F.length(_digits(match)).between(low, high)


def _card(match: Column) -> Column:
    digits = _digits(match)
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def _ip(match: Column) -> Column:
    part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]?)"
    return match.rlike(rf"\A{part}(?:\.{part}){{3}}\z")


def _iban(match: Column) -> Column:
    """ISO 7064: with the first four characters at the end and letters as 10 to 35, the number modulo 97 is 1."""
    plain = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substring(plain, 5, 34), F.substring(plain, 1, 4))

    def step(rest: Column, char: Column) -> Column:
        letter = char >= "A"
        value = F.when(letter, F.ascii(char) - 55).otherwise(F.ascii(char) - 48)
        return (rest * F.when(letter, 100).otherwise(10) + value) % 97

    rest = F.aggregate(F.split(turned, ""), F.lit(0), step)
    return F.length(plain).between(15, 34) & (rest == 1)


#: Characters of an IBAN by country (the registry of ISO 13616).
IBAN_SIZES = {
    country: size
    for size, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}


def _iban_size(text: Column, start: Column) -> Column:
    """The size of the IBAN that begins there: the country's number of characters, or the most of any other's that pass.

    Blanks, capitals and digits that follow belong to the text, so every end of a word is tried.
    """
    ahead = F.regexp_extract(F.substr(text, start + 1, F.lit(67)), r"\A[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}", 0)
    known = F.create_map(*(F.lit(x) for pair in IBAN_SIZES.items() for x in pair))

    def ends(size: Column) -> Column:
        part = F.substr(ahead, F.lit(1), size)
        plain = F.length(F.regexp_replace(part, " ", ""))
        whole = ~F.substr(text, start + size + 1, F.lit(1)).rlike("[A-Za-z0-9]") & ~part.endswith(" ")
        wanted = F.coalesce(F.try_element_at(known, F.substr(ahead, F.lit(1), F.lit(2))), plain)
        return whole & (plain == wanted) & _iban(part)

    sizes = F.sequence(F.lit(15), F.greatest(F.char_length(ahead), F.lit(15)))
    return F.when(ahead != "", F.array_max(F.filter(sizes, ends)))


def _yes(match: Column) -> Column:
    return F.lit(True)


#: Fixed order: results list the kinds in this order.
KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@",
        _yes,
        "mail|contact|write to|kontakt|correo|courriel",
        0.9,
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"[0-9]\.[0-9]",
        _ip,
        r"\bip\b|address|host|server|adresse|dirección",
        0.7,
    ),
    Kind("card", r"[0-9](?:[ -]?+[0-9])++", r"[0-9](?:[ -]?[0-9]){12}", _card, "card|visa|pay|karte|carte|tarjeta", 0.7),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", _between(9, 15), "phone|call|tel|mobil|fax|llam", 0.8),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?: ?[A-Z0-9]){11})",
        r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11}",
        _yes,
        "iban|account|bank|konto|compte|cuenta",
        0.8,
        base=False,
        size=_iban_size,
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        _yes,
        r"\bssn\b|social security",
        0.3,
        base=False,
    ),
)


def _places(text: Column, kind: Kind) -> Column:
    """All matches of the kind's pattern with their places, from left to right."""
    pattern = F.lit(kind.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, kind.pattern, -1)
    pairs = F.zip_with(
        matches,
        F.slice(gaps, F.lit(1), F.size(matches)),
        lambda match, gap: F.struct(F.char_length(gap).alias("gap"), match.alias("match")),
    )

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["gap"]
        end = start + F.char_length(pair["match"])
        span = F.struct(
            F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), pair["match"].alias("match")
        )
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(span)).alias("found")).cast(_STATE)

    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("found")).cast(_STATE)
    return F.aggregate(pairs, start, step, lambda state: state["found"])


def _scored(text: Column, kind: Kind) -> Column:
    """The kind's spans that pass its check, and its threshold if it has one, with their score."""

    def score(span: Column) -> Column:
        begin = F.greatest(span["start"] - NEAR, F.lit(0))
        around = F.substr(text, begin + 1, span["end"] + NEAR - begin)
        near = F.lower(around).rlike(kind.near)
        return F.struct(
            span["kind"].alias("kind"),
            span["start"].alias("start"),
            span["end"].alias("end"),
            F.least(F.lit(1.0), F.lit(kind.prior) + F.when(near, NEAR_BONUS).otherwise(0.0)).alias("score"),
        )

    def grown(span: Column) -> Column:
        end = span["start"] + kind.size(text, span["start"])
        return F.struct(span["kind"].alias("kind"), span["start"].alias("start"), end.alias("end"), span["match"].alias("match"))

    places = F.filter(_places(text, kind), lambda span: kind.holds(span["match"]))
    if kind.size:
        places = F.filter(F.transform(places, grown), lambda span: span["end"].isNotNull())
    held = F.transform(places, score)
    if not kind.base:
        held = F.filter(held, lambda span: span["score"] >= THRESHOLD)
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    return F.when(text.rlike(kind.hint), held).otherwise(none)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, text and spans: kind, start, end (code points, end exclusive) and score of each, by kind, then start.

    Kinds are looked for independently, so spans of two kinds may overlap. Null text is empty and has no spans; a
    null doc_id and repeated rows stay as they are; other columns are not read.
    """
    texts = docs.select("doc_id", whole_text().alias("text"))
    return texts.withColumn("spans", F.concat(*(_scored(F.col("text"), kind) for kind in KINDS)))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, all spans as text, and the highest score."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = [kind.name for kind in KINDS if kind.base]

    def count(name: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    return found.select(
        "doc_id",
        *map(count, base),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, and ``n_chars``, if there is one, counted anew.

    Of overlapping spans, the one that begins first (the longer of two) names the whole stretch. Null text stays null.
    """
    text = F.col("`text`")
    spans = F.concat(*(_scored(text, kind) for kind in KINDS))
    ordered = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind")))
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    kind_of = "struct<at:int,parts:array<string>>"

    def step(state: Column, span: Column) -> Column:
        end = F.greatest(state["at"], -span["back"])
        gap = F.substr(text, state["at"] + 1, span["start"] - state["at"])
        mark = F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))
        fresh = F.concat(state["parts"], F.array(gap, mark))
        return F.struct(
            end.alias("at"), F.when(span["start"] >= state["at"], fresh).otherwise(state["parts"]).alias("parts")
        ).cast(kind_of)

    def finish(state: Column) -> Column:
        tail = F.substr(text, state["at"] + 1, F.char_length(text))
        return F.array_join(F.concat(state["parts"], F.array(tail)), "")

    hinted = text.rlike("|".join(f"(?:{kind.hint})" for kind in KINDS))
    clean = F.when(hinted, F.aggregate(ordered, start.cast(kind_of), step, finish)).otherwise(text)
    out = docs.withColumn("text", clean)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars")))
    return out
