"""Quality classifier: a sparse ensemble of rules over statistics of the text.

Small trees are grown on a bounded sample of labelled rows, each on the errors that those before it leave. Every
path from a root to a node is a conjunctive rule ("few distinct lines and many signs"). A logistic regression with
an L1 penalty weighs the rules and drops most of them. What is left is compiled into one Spark column expression, so
scoring reads each text once and runs no Python.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import hash_share, whole_text

#: Labelled rows that the rules are fitted on, at most.
SAMPLE_ROWS = 20_000
TREES = 40
DEPTH = 3
LEAST_ROWS = 5
PENALTIES = (0.03, 0.01, 0.003, 0.001)


def _share(count: Column, of: Column) -> Column:
    return count / F.greatest(of, F.lit(1))


def _without(text: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(text, pattern, ""))


def statistics(text: Column) -> dict[str, Column]:
    """Numbers about a whole text, all defined (0 where there is nothing to count)."""
    chars = F.char_length(text)
    letters = chars - _without(text, r"\p{L}+")
    capitals = chars - _without(text, r"\p{Lu}+")
    digits = chars - _without(text, r"\p{Nd}+")
    spaces = chars - _without(text, r"\s+")
    signs = chars - letters - digits - spaces
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    count, number = F.size(words), F.size(lines)
    ends = F.size(F.split(text, r"[.!?](?:\s|\z)")) - 1
    runs = chars - _without(text, r"(?<=([^\p{L}\p{N}\s]))\1")
    return {
        "chars": F.log1p(chars),
        "words": F.log1p(count),
        "word_length": _share(letters, count),
        "letters": _share(letters, chars),
        "capitals": _share(capitals, letters),
        "digits": _share(digits, chars),
        "signs": _share(signs, chars),
        "sign_runs": _share(runs, chars),
        "distinct_words": _share(F.size(F.array_distinct(words)), count),
        "distinct_lines": _share(F.size(F.array_distinct(lines)), number),
        "line_length": F.log1p(_share(chars, number)),
        "sentence_length": F.log1p(_share(count, F.greatest(ends, F.lit(1)))),
        "bars": _share(chars - F.char_length(F.translate(text, "|", "")), count),
        "marks": _share(chars - F.char_length(F.translate(text, "!?", "")), count),
    }


#: The statistics in the order in which rules number them.
FEATURES = (
    "chars", "words", "word_length", "letters", "capitals", "digits", "signs", "sign_runs", "distinct_words",
    "distinct_lines", "line_length", "sentence_length", "bars", "marks",
)

#: A condition: (number of the statistic, threshold, whether the value must lie above it).
Condition = tuple[int, float, bool]


@dataclass
class Ensemble:
    """Rules with their weights: log odds are the sum of those that hold, and the base."""

    base: float
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)


def _best_split(x: np.ndarray, residual: np.ndarray, grid: list[np.ndarray]) -> tuple[float, int, float] | None:
    """The split that lowers the squared error most: (gain, statistic, threshold)."""
    best = None
    total, count = residual.sum(), len(residual)
    for j, cuts in enumerate(grid):
        place = np.searchsorted(cuts, x[:, j], "left")  # value <= cuts[k] lies in a bin up to k
        sums = np.cumsum(np.bincount(place, residual, len(cuts) + 1))[:-1]
        sizes = np.cumsum(np.bincount(place, minlength=len(cuts) + 1))[:-1]
        fits = (sizes >= LEAST_ROWS) & (count - sizes >= LEAST_ROWS)
        if fits.any():
            gain = sums**2 / np.maximum(sizes, 1) + (total - sums) ** 2 / np.maximum(count - sizes, 1) - total**2 / count
            k = int(np.argmax(np.where(fits, gain, -1)))
            if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                best = (float(gain[k]), j, float(cuts[k]))
    return best


def _grow(
    x: np.ndarray, residual: np.ndarray, grid: list[np.ndarray], path: tuple[Condition, ...], depth: int
) -> tuple[np.ndarray, list[tuple[Condition, ...]]]:
    """The tree's fitted values, and the paths to its nodes."""
    split = _best_split(x, residual, grid) if depth and len(residual) >= 2 * LEAST_ROWS else None
    if split is None:
        return np.full(len(residual), residual.mean() if len(residual) else 0.0), []
    _, j, cut = split
    above = x[:, j] > cut
    fitted, paths = np.empty(len(residual)), []
    for side in (False, True):
        own = above == side
        longer = (*path, (j, cut, side))
        values, deeper = _grow(x[own], residual[own], grid, longer, depth - 1)
        fitted[own] = values
        paths += [longer, *deeper]
    return fitted, paths


def _tidy(path: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """The same rule with one bound for each statistic and side, in a fixed order."""
    bounds: dict[tuple[int, bool], float] = {}
    for j, cut, above in path:
        known = bounds.get((j, above))
        bounds[j, above] = cut if known is None else max(known, cut) if above else min(known, cut)
    return tuple(sorted((j, cut, above) for (j, above), cut in bounds.items()))


def holds(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, j] > cut) == above for j, cut, above in rule])


def extract_rules(x: np.ndarray, y: np.ndarray, seed: int = 3) -> list[tuple[Condition, ...]]:
    """The distinct paths of trees grown in turn on halves of the rows, each on what is left unexplained."""
    random, grid = np.random.default_rng(seed), []
    for j in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, 60)))
        grid.append((cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts)
    log_odds, found = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), {}
    for _ in range(TREES):
        residual = y - 1 / (1 + np.exp(-log_odds))
        part = random.permutation(len(y))[: max(2 * LEAST_ROWS, len(y) // 2)]
        _, paths = _grow(x[part], residual[part], grid, (), int(random.integers(1, DEPTH + 1)))
        found |= dict.fromkeys(map(_tidy, paths))
        for path in paths:
            own = holds(path, x)
            if own.any():
                log_odds[own] += 0.3 * residual[own].mean()
    return list(found)


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights, by accelerated proximal gradient steps."""
    rows = len(y)
    size = 4.0 * rows / max(1.0, np.linalg.norm(z, 2) ** 2 + rows)
    base, weights = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), np.zeros(z.shape[1])
    ahead, ahead_base, pace = weights.copy(), base, 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(z @ ahead + ahead_base))) - y
        moved = ahead - size * (z.T @ error) / rows
        fresh = np.sign(moved) * np.maximum(np.abs(moved) - size * penalty, 0)
        fresh_base = ahead_base - size * float(error.mean())
        faster = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        ahead = fresh + (pace - 1) / faster * (fresh - weights)
        ahead_base = fresh_base + (pace - 1) / faster * (fresh_base - base)
        weights, base, pace = fresh, fresh_base, faster
    return base, weights


def train(x: np.ndarray, y: np.ndarray, seed: int = 3) -> Ensemble:
    """Fit an ensemble; a fifth of the rows, which trees and weights don't see, chooses the penalty."""
    if len(y) == 0:
        return Ensemble(0.0)
    if y.min() == y.max() or len(y) < 4 * LEAST_ROWS:
        return Ensemble(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    order = np.random.default_rng(seed).permutation(len(y))
    probe, rest = order[: len(y) // 5], order[len(y) // 5 :]
    rules = extract_rules(x[rest], y[rest], seed)
    z = np.stack([holds(rule, x) for rule in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    best = None
    for penalty in PENALTIES:
        base, weights = lasso_logistic(z[rest], y[rest], penalty)
        odds = z[probe] @ weights + base
        loss = float(np.mean(np.logaddexp(0, odds) - y[probe] * odds))
        if best is None or loss < best[0] - 1e-4:
            best = (loss, base, weights)
    _, base, weights = best
    return Ensemble(base, [(rules[i], float(weights[i])) for i in np.flatnonzero(np.abs(weights) > 1e-6)])


def compiled(model: Ensemble) -> Column:
    """The probability of label 1 as an expression over columns named like the statistics."""

    def condition(part: Condition) -> Column:
        j, cut, above = part
        return F.col(FEATURES[j]) > F.lit(cut) if above else F.col(FEATURES[j]) <= F.lit(cut)

    terms = [
        F.when(reduce(lambda a, b: a & b, map(condition, rule)), F.lit(weight)).otherwise(F.lit(0.0))
        for rule, weight in model.rules
    ]
    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(model.base))))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of its id, as text, modulo 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _measured(docs: DataFrame, *keep: str) -> DataFrame:
    return docs.select(*keep, *(column.cast("double").alias(name) for name, column in statistics(whole_text()).items()))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Ensemble:
    """Fit on labelled rows that aren't held out: those whose ids have the smallest hashes.

    Labels other than 0 and 1 don't count, nor ids whose labels contradict each other.
    """
    usable = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
        .where("quality = other")
        .select("doc_id", "quality")
    )
    chosen = (
        usable.where(hash_share("doc_id", usable.count(), sample_rows))
        .orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)), "doc_id")
        .limit(sample_rows)
    )
    # At most sample_rows rows of two numbers, so the broadcast is bounded.
    rows = _measured(docs.join(F.broadcast(chosen), "doc_id"), "doc_id", "quality").toPandas()
    rows = rows.sort_values(["doc_id", *FEATURES]).drop_duplicates()
    return train(rows[list(FEATURES)].to_numpy(float), rows["quality"].to_numpy(float))


def score(docs: DataFrame, model: Ensemble) -> DataFrame:
    """doc_id, held_out, score and predicted for each row, from the text alone.

    Null text is scored as the empty text. Rows that repeat get the same score; a null doc_id stays null and isn't
    held out; an empty table gives an empty result; without labels every score is 0.5.
    """
    measured = _measured(docs, "doc_id")
    return measured.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), compiled(model).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def described(model: Ensemble) -> list[str]:
    """The rules as text, the heaviest first."""
    heaviest = sorted(model.rules, key=lambda r: -abs(r[1]))
    return [
        f"{weight:+.3f} if " + " and ".join(f"{FEATURES[j]} {'>' if above else '<='} {cut:.4g}" for j, cut, above in rule)
        for rule, weight in heaviest
    ]
