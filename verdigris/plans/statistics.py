"""Catalog statistics: the unit table reduced once to vote counts that every report starts from."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import profiles, recommend, similarity, summary, votes
from ..operators.votes import ASPECT_KEYS, PAIR_KEYS
from ..session import cut_lineage


@dataclass
class CatalogStatistics:
    """Vote counts per product and aspect (pair), and what derives from them alone.

    Derived tables used more than once are kept too: all are products times taxonomy at most.
    """

    products: DataFrame
    review_counts: DataFrame
    aspect_counts: DataFrame
    pair_counts: DataFrame

    @classmethod
    def compute(
        cls, units: DataFrame, products: DataFrame, reviews: DataFrame
    ) -> CatalogStatistics:
        """One job, and one pass, over the units; the counts are kept, being products times taxonomy."""
        kept = cut_lineage(votes.count_votes(votes.both_grains(units), ["product_id", "grain", *PAIR_KEYS]))
        review_counts = cut_lineage(summary.product_review_counts(products, reviews))
        return cls(
            products,
            review_counts,
            kept.filter(F.col("grain") == "aspect").drop("grain", "status_id", "status"),
            kept.filter(F.col("grain") == "pair").drop("grain"),
        )

    @cached_property
    def named_counts(self) -> DataFrame:
        return self.review_counts.select("product_id", "product_name", "review_count")

    @cached_property
    def aspect_matrix(self) -> DataFrame:
        return summary.sentiment_matrix(self.aspect_counts, self.named_counts, ASPECT_KEYS)

    @cached_property
    def pair_matrix(self) -> DataFrame:
        return summary.sentiment_matrix(self.pair_counts, self.named_counts, PAIR_KEYS)

    @cached_property
    def profile(self) -> DataFrame:
        return cut_lineage(profiles.smoothed_profile(self.aspect_counts, self.named_counts))

    @cached_property
    def profile_arrays(self) -> DataFrame:
        return cut_lineage(similarity.profile_arrays(self.profile, self.products))

    @cached_property
    def pair_rates(self) -> DataFrame:
        return profiles.pair_rates(self.pair_counts, self.named_counts)

    @cached_property
    def pair_profiles(self) -> DataFrame:
        return cut_lineage(profiles.pair_profiles(self.pair_counts))

    @cached_property
    def weaknesses(self) -> tuple[DataFrame, DataFrame]:
        weaknesses, excluded = recommend.source_weaknesses(self.pair_matrix)
        return cut_lineage(weaknesses), excluded

    def similar_products(self) -> DataFrame:
        ranked = cut_lineage(similarity.similar_products(self.profile_arrays))
        return similarity.pair_components(
            ranked, self.profile, self.pair_rates, self.named_counts
        )

    def rank(self, requests: DataFrame, policy: str, limit: int = 3) -> DataFrame:
        strengths = recommend.strengths(self.pair_profiles, policy)
        candidates = recommend.candidate_arrays(strengths, self.profile_arrays)
        return recommend.rank_candidates(requests, candidates, policy, limit)

    def weakness_repairs(self) -> DataFrame:
        requests = recommend.product_requests(self.weaknesses[0], self.profile_arrays)
        return cut_lineage(self.rank(requests, recommend.STATIC))

    def weakness_repair_matches(self, ranked: DataFrame | None = None) -> DataFrame:
        conditions = self.weaknesses[0].select(
            F.col("product_id").alias("request_id"),
            "condition_id",
            "aspect_id",
            "status_id",
            "aspect",
            "status",
        )
        return recommend.condition_matches(
            self.weakness_repairs() if ranked is None else ranked,
            conditions,
            recommend.strengths(self.pair_profiles, recommend.STATIC),
        )
