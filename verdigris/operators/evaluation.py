"""Evaluation of ratings and clusters: bootstrap intervals, factorial effects, agreement, silhouette."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sentiment import first_match, rounded
from ..functions.vectors import distance_matrix, unit_matrix
from .tiles import block_pairs

ARMS = ("A", "B", "C", "D")
RESAMPLES = 5000
SEED = 17171771
BLOCK_ROWS = 4096


def item_means(ratings: DataFrame) -> DataFrame:
    """Raters are averaged first: items are the statistical units."""
    return ratings.groupBy("item_id", "arm").agg(F.avg("score").alias("score"))


def rating_summary(ratings: DataFrame) -> DataFrame:
    """Item count, mean and standard deviation of the item means per arm."""
    return item_means(ratings).groupBy("arm").agg(
        F.count(F.lit(1)).alias("item_count"),
        rounded(F.avg("score")).alias("mean_score"),
        rounded(F.stddev_samp("score")).alias("sd_score"),
    )


def factorial_effects(ratings: DataFrame) -> DataFrame:
    """Mean structure, clustering and interaction effects over items rated in all four arms."""
    wide = complete_items(ratings)
    a, b, c, d = (F.col(arm) for arm in ARMS)
    return wide.agg(
        F.count(F.lit(1)).alias("item_count"),
        rounded(F.avg(((c + d) - (a + b)) / 2)).alias("structured_effect"),
        rounded(F.avg(((b + d) - (a + c)) / 2)).alias("clustering_effect"),
        rounded(F.avg((d - c) - (b - a))).alias("interaction_effect"),
    )


def complete_items(ratings: DataFrame) -> DataFrame:
    """One row per item rated in all four arms, one column per arm."""
    return item_means(ratings).groupBy("item_id").pivot("arm", list(ARMS)).avg("score").dropna()


def _split_shares(placed: DataFrame, levels: int) -> DataFrame:
    """For each block and level of the tree of splits above it, the share of rows in the left half."""
    counted = placed.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    steps = counted.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))) if levels else None
    if steps is None:
        return counted.select(F.col("block").alias("of_block"), F.lit(0).alias("level"), F.lit(1.0).alias("left_share")).filter("level > 0")
    shift = F.lit(levels) - F.col("level")
    node = F.expr("shiftright(block, cast(shift as int))")
    right = F.expr("shiftright(block, cast(shift as int) - 1)") % 2
    placed_steps = steps.withColumn("shift", shift).withColumns({"node": node, "right": right})
    halves = placed_steps.groupBy("level", "node").agg(
        (F.sum(F.when(F.col("right") == 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("left_share")
    )
    found = placed_steps.join(halves, ["level", "node"])
    return found.select(F.col("block").alias("of_block"), "level", "left_share")


def bootstrap_means(
    values: DataFrame, key: str, columns: list[str], resamples: int = RESAMPLES, seed: int = SEED
) -> DataFrame:
    """95% bootstrap intervals of column means, resampling rows with replacement.

    Rows are hashed into blocks. Every block finds its number of draws per resample by walking the
    same seeded binary splits, so the counts of all blocks form one multinomial without talking to
    each other; a second multinomial picks rows inside the block. A block sends one partial sum per
    resample: neither rows times resamples nor all rows meet in one place.
    """
    total = values.count()
    blocks = max(1, -(-total // BLOCK_ROWS))
    levels = (blocks - 1).bit_length()
    placed = values.select(
        F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), key, *columns
    )
    schema = "resample int, " + ", ".join(f"{name} double" for name in columns)

    def block_draws(block: int, shares: dict) -> np.ndarray:
        draws = np.full(resamples, total)
        for level in range(levels):
            node = block >> (levels - level)
            left = np.random.default_rng([seed, level, node]).binomial(draws, shares[level])
            right = (block >> (levels - level - 1)) & 1
            draws = draws - left if right else left
        return draws

    def draw(frame: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(key)
        block = int(frame["block"].iloc[0])
        data = frame[columns].to_numpy(dtype=float)
        inside = np.random.default_rng([seed, levels, block])
        uniform = np.full(len(frame), 1.0 / len(frame))
        sums = np.zeros((resamples, len(columns)))
        shares = dict(zip(path["level"], path["left_share"], strict=True))
        for number, count in enumerate(block_draws(block, shares)):
            sums[number] = inside.multinomial(count, uniform) @ data
        return pd.DataFrame(sums, columns=columns).assign(resample=np.arange(resamples))[
            ["resample", *columns]
        ]

    paths = _split_shares(placed, levels)
    grouped = placed.groupBy("block").cogroup(paths.groupBy("of_block"))
    partial = grouped.applyInPandas(draw, schema)
    means = partial.groupBy("resample").agg(
        *[(F.sum(name) / F.lit(float(total))).alias(name) for name in columns]
    )
    melted = means.unpivot("resample", columns, "statistic", "mean")
    bounds = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))
    return melted.groupBy("statistic").agg(
        rounded(F.avg("mean")).alias("bootstrap_mean"),
        rounded(bounds[0]).alias("lower_95"),
        rounded(bounds[1]).alias("upper_95"),
    )


def preference_rates(choices: DataFrame) -> DataFrame:
    """How often each arm was preferred."""
    counted = choices.groupBy("arm").agg(F.count(F.lit(1)).alias("preference_count"))
    total = F.sum("preference_count").over(W.partitionBy(F.lit(1)))
    return counted.withColumn("preference_rate", rounded(F.col("preference_count") / total))


def cohort_violations(ratings: DataFrame, minimum_raters: int = 3) -> DataFrame:
    """Rater-item pairs without each arm exactly once and one preference, and invalid scores."""
    score = F.col("score")
    arm_bit = first_match(
        [(F.col("arm") == arm, F.lit(1 << place)) for place, arm in enumerate(ARMS)], F.lit(0)
    )
    per_pair = ratings.groupBy("rater_id", "item_id").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.bit_or(arm_bit).alias("arms"),
        F.count_if(F.col("preferred")).alias("preferences"),
        F.count_if((score != F.floor(score)) | ~score.between(1, 5)).alias("invalid_scores"),
    )
    broken = (
        (F.col("row_count") != len(ARMS))
        | (F.col("arms") != (1 << len(ARMS)) - 1)
        | (F.col("preferences") != 1)
        | (F.col("invalid_scores") > 0)
    )
    return per_pair.filter(broken)


def icc_agreement(ratings: DataFrame) -> DataFrame:
    """ICC(2,1): two-way random effects, absolute agreement, single rating.

    Uses items every rater rated. Sums of squares come from grouped sums, so ratings are read by
    aggregations only.
    """
    cells = ratings.groupBy("item_id", "rater_id").agg(F.avg("score").alias("x"))
    raters = cells.select("rater_id").distinct().agg(F.count(F.lit(1)).alias("k"))
    items = cells.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("rated"), F.sum("x").alias("item_sum")
    )
    complete = items.join(raters, F.col("rated") == F.col("k"))
    kept = cells.join(complete.select("item_id", "k"), "item_id")
    totals = kept.agg(
        F.sum("x").alias("g"),
        F.sum(F.col("x") * F.col("x")).alias("xx"),
        F.max("k").cast("double").alias("k"),
    )
    by_item = complete.agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(F.col("item_sum") * F.col("item_sum")).alias("ii"),
    )
    by_rater = (
        kept.groupBy("rater_id")
        .agg(F.sum("x").alias("s"))
        .agg(F.sum(F.col("s") * F.col("s")).alias("rr"))
    )
    one = F.lit(1)
    table = (
        totals.withColumn("one", one)
        .join(by_item.withColumn("one", one), "one")
        .join(by_rater.withColumn("one", one), "one")
    )
    n, k = F.col("n"), F.col("k")
    correction = F.col("g") * F.col("g") / (n * k)
    between_items = F.col("ii") / k - correction
    between_raters = F.col("rr") / n - correction
    error = F.col("xx") - correction - between_items - between_raters
    table = table.select(
        "n",
        "k",
        (between_items / (n - 1)).alias("msr"),
        (between_raters / (k - 1)).alias("msc"),
        (error / ((n - 1) * (k - 1))).alias("mse"),
    )
    msr, msc, mse = F.col("msr"), F.col("msc"), F.col("mse")
    icc = (msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n)
    return table.select(
        n.cast("long").alias("item_count"),
        k.cast("long").alias("rater_count"),
        rounded(icc).alias("icc_2_1"),
    )


def risk_coverage(clusters: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Share of listed risky clusters (stage, cluster_id) that were evaluated, per stage."""
    marked = clusters.join(
        evaluated.select("cluster_id").distinct().withColumn("hit", F.lit(1)), "cluster_id", "left"
    )
    return marked.groupBy("stage").agg(
        F.count(F.lit(1)).alias("bounded_risky_cluster_count"),
        F.count("hit").alias("evaluated_risky_cluster_count"),
        rounded(F.count("hit") / F.count(F.lit(1))).alias("coverage_rate"),
    )


def cluster_sums(members: DataFrame) -> DataFrame:
    """boundary, cluster_id, n and the sum of the unit vectors of each cluster.

    Every task adds up what it holds of a cluster, so a cluster of any size moves as one vector for each task.
    """

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ordered = frame.sort_values(["boundary", "cluster_id"], kind="stable")
            keys = ordered[["boundary", "cluster_id"]].reset_index(drop=True)
            if keys.empty:
                continue
            first = np.flatnonzero((keys != keys.shift()).any(axis=1))
            sums = np.add.reduceat(unit_matrix(ordered["embedding"]), first, axis=0)
            sizes = np.diff([*first, len(keys)])
            yield keys.iloc[first].assign(n=sizes, part=list(sums))

    kinds = "boundary string, cluster_id string, n long, part array<double>"
    parts = members.select("boundary", "cluster_id", "embedding").mapInPandas(partial, kinds)
    grain = ["boundary", "cluster_id"]
    entries = parts.select(*grain, F.posexplode("part").alias("place", "entry"), "n")
    summed = entries.groupBy(*grain, "place").agg(F.sum("entry").alias("entry"), F.sum("n").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct("place", "entry")))
    return summed.groupBy(*grain).agg(F.max("n").alias("n"), listed["entry"].alias("total"))


def silhouettes(members: DataFrame, block_rows: int = 2048) -> DataFrame:
    """Mean silhouette per cluster inside its boundary (boundary, cluster_id, text, embedding).

    The mean cosine distance of a unit vector x to a cluster with vector sum S and n members is 1 - x.S / n, so nodes
    meet cluster sums instead of nodes, and a block passes on one row for each of its nodes: the mean distance to the
    others of its own cluster, and the smallest mean distance to another one.
    """

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        vectors, sums = unit_matrix(left["embedding"]), np.stack(right["total"])
        sizes = right["n"].to_numpy(dtype=float)
        shared = vectors @ sums.T
        own = left["cluster_id"].to_numpy()[:, None] == right["cluster_id"].to_numpy()[None, :]
        inside = np.full(len(left), np.nan)
        rows, columns = np.nonzero(own & (sizes > 1)[None, :])
        others = sizes[columns] - 1
        itself = (vectors[rows] ** 2).sum(axis=1)
        inside[rows] = np.clip((others - (shared[rows, columns] - itself)) / others, 0.0, 2.0)
        outside = np.where(own, np.inf, np.clip(1.0 - shared / sizes[None, :], 0.0, 2.0)).min(axis=1)
        return pd.DataFrame(
            {
                "boundary": left["boundary"],
                "cluster_id": left["cluster_id"],
                "text": left["text"],
                "a": [None if np.isnan(v) else v for v in inside],
                "b": [None if np.isinf(v) else v for v in outside],
            }
        )

    rows = members.select(
        F.col("boundary").cast("string").alias("boundary"), "cluster_id", "text", "embedding"
    )
    per_node = block_pairs(
        rows,
        cluster_sums(rows),
        kernel,
        "boundary string, cluster_id string, text string, a double, b double",
        left_key=F.col("text"),
        right_key=F.col("cluster_id"),
        left_boundary=F.col("boundary"),
        right_boundary=F.col("boundary"),
        left_rows=block_rows,
        right_rows=block_rows,
    ).groupBy("boundary", "cluster_id", "text").agg(F.max("a").alias("a"), F.min("b").alias("b"))
    a, b = F.col("a"), F.col("b")
    value = F.when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(
        F.coalesce((b - a) / F.nullif(F.greatest(a, b), F.lit(0.0)), F.lit(0.0))
    )
    return per_node.groupBy("boundary", "cluster_id").agg(
        F.count(F.lit(1)).alias("member_count"),
        rounded(F.avg(value)).alias("cluster_silhouette_mean"),
    )


def nearest_cluster_pairs(
    clusters: DataFrame, limit: int = 50, block_rows: int = 2048
) -> DataFrame:
    """The ``limit`` closest pairs of cluster centroids (cluster_id, embedding).

    Every pair of blocks passes on its own closest ``limit`` pairs.
    """

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        low, high = left["cluster_id"].to_numpy(), right["cluster_id"].to_numpy()
        distances = distance_matrix(unit_matrix(left["embedding"]), unit_matrix(right["embedding"]))
        rows, columns = np.nonzero(low[:, None] < high[None, :])
        pairs = pd.DataFrame(
            {"lo": low[rows], "hi": high[columns], "distance": np.round(distances[rows, columns], 8)}
        )
        return pairs.sort_values(["distance", "lo", "hi"]).head(limit)

    rows = clusters.select("cluster_id", "embedding")
    found = block_pairs(
        rows,
        rows,
        kernel,
        "lo string, hi string, distance double",
        left_key=F.col("cluster_id"),
        right_key=F.col("cluster_id"),
        left_rows=block_rows,
        right_rows=block_rows,
    )
    return found.orderBy("distance", "lo", "hi").limit(limit)
