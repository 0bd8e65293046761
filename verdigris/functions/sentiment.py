"""Sentiment columns: vote masks, Wilson bounds, entropy and the full distribution."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import KNOWN_SENTIMENTS, SENTIMENTS, WILSON_Z

_BITS = {name: 1 << position for position, name in enumerate(SENTIMENTS)}
_KNOWN_MASK = sum(_BITS[name] for name in KNOWN_SENTIMENTS)


def rounded(value: Column, places: int = 6) -> Column:
    """Half-even rounding without negative zero, in plain double arithmetic.

    ``bround`` goes through a decimal for every value; on wide summaries that dominates the stage.
    """
    scale = F.lit(10.0**places)
    return F.rint(value.cast("double") * scale) / scale + F.lit(0.0)


def first_match(cases: Iterable[tuple[Column, object]], otherwise: object = None) -> Column:
    """``CASE`` over ordered (condition, value) cases."""
    pairs = list(cases)
    start = F.when(pairs[0][0], pairs[0][1])
    chained = reduce(lambda acc, case: acc.when(case[0], case[1]), pairs[1:], start)
    return chained.otherwise(otherwise)


def sentiment_bit(sentiment: Column) -> Column:
    """One bit per sentiment, so that a group of labels is a fixed-width ``bit_or`` buffer."""
    return first_match([(sentiment == name, F.lit(bit)) for name, bit in _BITS.items()], F.lit(0))


def vote_mask(sentiment: Column) -> Column:
    """Aggregate: the set of labels seen in the group."""
    return F.bit_or(sentiment_bit(sentiment))


def collapse_mask(mask: Column) -> Column:
    """Unknown yields to any known label; two different known labels are mixed."""
    known = mask.bitwiseAND(F.lit(_KNOWN_MASK))
    cases = [(known == 0, F.lit("unknown"))]
    cases += [(known == _BITS[name], F.lit(name)) for name in KNOWN_SENTIMENTS]
    return first_match(cases, F.lit("mixed"))


def wilson_bounds(successes: Column, total: Column) -> tuple[Column, Column]:
    """Wilson score bounds clamped to [0, 1]; (0, 0) for an empty sample."""
    z2 = WILSON_Z * WILSON_Z
    n = F.when(total > 0, total.cast("double"))
    p = successes / n
    denominator = F.lit(1.0) + F.lit(z2) / n
    centre = p + F.lit(z2) / (F.lit(2.0) * n)
    margin = F.lit(WILSON_Z) * F.sqrt((p * (F.lit(1.0) - p) + F.lit(z2) / (F.lit(4.0) * n)) / n)
    zero, one = F.lit(0.0), F.lit(1.0)
    lower = F.when(n.isNull(), zero).otherwise(F.greatest(zero, (centre - margin) / denominator))
    upper = F.when(n.isNull(), zero).otherwise(F.least(one, (centre + margin) / denominator))
    return lower, upper


def vote_counts(vote: Column, weight: Column | None = None) -> list[Column]:
    """Aggregates: one count per sentiment plus the number of votes."""
    counts = [F.count_if(vote == name).alias(f"{name}_count") for name in SENTIMENTS]
    return [F.count(F.lit(1)).alias("supporting_review_count"), *counts]


def normalized_entropy(counts: dict[str, Column], total: Column) -> Column:
    terms = []
    for column in counts.values():
        p = column / F.when(total > 0, total.cast("double"))
        terms.append(F.when(column > 0, -p * F.log2(p)).otherwise(F.lit(0.0)))
    entropy = reduce(lambda a, b: a + b, terms) / F.log2(F.lit(float(len(SENTIMENTS))))
    return F.when(total > 0, entropy)


def dominant_sentiment(counts: dict[str, Column], total: Column) -> Column:
    """Largest count; the earlier sentiment wins a tie."""
    top = F.greatest(*counts.values())
    return F.when(
        total > 0, first_match([(counts[name] == top, F.lit(name)) for name in SENTIMENTS])
    )


def distribution_columns(
    total: Column | None = None, counts: dict[str, Column] | None = None, prefix: str = ""
) -> list[Column]:
    """Shares, dominant label, Wilson bounds and entropy from count columns."""
    total = F.col("supporting_review_count") if total is None else total
    counts = counts or {name: F.col(f"{name}_count") for name in SENTIMENTS}
    filled = F.when(total > 0, total.cast("double"))
    dominant = dominant_sentiment(counts, total)
    columns = [
        rounded(counts[name] / filled).alias(f"{prefix}{name}_share") for name in SENTIMENTS
    ]
    columns.append(dominant.alias(f"{prefix}dominant_sentiment"))
    columns.append(
        rounded(F.greatest(*counts.values()) / filled).alias(f"{prefix}dominant_share")
    )
    for name in ("positive", "negative"):
        lower, upper = wilson_bounds(counts[name], total)
        columns.append(F.when(total > 0, rounded(lower)).alias(f"{prefix}{name}_wilson_lower"))
        columns.append(F.when(total > 0, rounded(upper)).alias(f"{prefix}{name}_wilson_upper"))
    columns.append(
        rounded(normalized_entropy(counts, total)).alias(f"{prefix}normalized_entropy")
    )
    return columns


def distribution_struct() -> Column:
    """The distribution as one nested value for report documents."""
    shares = {name: f"{name}_share" for name in SENTIMENTS}
    return F.struct(
        F.struct(*[F.col(f"{name}_count").alias(name) for name in SENTIMENTS]).alias("counts"),
        F.struct(*[F.col(column).alias(name) for name, column in shares.items()]).alias("shares"),
        F.col("dominant_sentiment"),
        F.col("dominant_share"),
        *[
            F.struct(
                F.col(f"{name}_wilson_lower").alias("lower"),
                F.col(f"{name}_wilson_upper").alias("upper"),
            ).alias(f"{name}_wilson_95")
            for name in ("positive", "negative")
        ],
        F.col("normalized_entropy"),
    )
