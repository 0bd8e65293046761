"""Markdown cells and Korean particles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"
_FIRST_SYLLABLE, _LAST_SYLLABLE, _FINALS = 0xAC00, 0xD7A3, 28


def cell(value: Column) -> Column:
    text = F.replace(value.cast("string"), F.lit("|"), F.lit("\\|"))
    for line_end in ("\r\n", "\n"):
        text = F.replace(text, F.lit(line_end), F.lit("<br>"))
    return F.coalesce(text, F.lit(DASH))


def bold(value: Column) -> Column:
    return F.concat(F.lit("**"), F.replace(cell(value), F.lit("*"), F.lit("\\*")), F.lit("**"))


def fixed(value: Column, places: int = 6) -> Column:
    return F.when(value.isNull(), F.lit(DASH)).otherwise(F.format_string(f"%.{places}f", value))


def percent(rate: Column) -> Column:
    return F.when(rate.isNull(), F.lit(DASH)).otherwise(
        F.format_string("%.1f%%", rate * F.lit(100.0))
    )


def count_and_rate(count: Column, rate: Column) -> Column:
    return F.concat(count.cast("string"), F.lit("("), percent(rate), F.lit(")"))


def table_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.array(*cells), " | "), F.lit(" |"))


def text(template: str, *values: Column) -> Column:
    """Fill ``{}`` places of a fixed text with columns."""
    parts = template.split("{}")
    pieces = [F.lit(parts[0])]
    for value, rest in zip(values, parts[1:], strict=True):
        pieces += [value.cast("string"), F.lit(rest)]
    return F.concat(*pieces)


def _final_consonant(value: Column) -> Column:
    """Index of the last syllable's final consonant (0 if none); NULL if not a Hangul syllable."""
    code = F.ascii(F.right(F.rtrim(value), F.lit(1)))
    return F.when(
        code.between(_FIRST_SYLLABLE, _LAST_SYLLABLE), (code - _FIRST_SYLLABLE) % _FINALS
    )


def topic_particle(value: Column) -> Column:
    final = _final_consonant(value)
    blank = F.length(F.rtrim(value)) == 0
    return F.when(blank | (final == 0), F.lit("는")).otherwise(F.lit("은"))


def directional_particle(value: Column) -> Column:
    final = _final_consonant(value)
    return F.when(final.isNull() | final.isin(0, 8), F.lit("로")).otherwise(F.lit("으로"))
