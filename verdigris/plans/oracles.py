"""DuckDB statements that state each registered query independently, over the same tables."""

from __future__ import annotations

import re

SENTIMENTS = ("positive", "negative", "mixed", "neutral", "unknown")
Z = "1.959963984540054::DOUBLE"


def r(expression: str, places: int = 6) -> str:
    """Half-even rounding to a double; adding zero removes a negative zero."""
    return f"(round_even(({expression})::DOUBLE, {places})::DOUBLE + 0.0::DOUBLE)"


def settled(expression: str) -> str:
    """Six places after removing float noise, for means of six-place values."""
    return r(f"round(({expression})::DOUBLE, 9)")


COLLAPSE = (
    "CASE WHEN count(DISTINCT sentiment) FILTER (WHERE sentiment <> 'unknown') = 0 THEN 'unknown' "
    "WHEN count(DISTINCT sentiment) FILTER (WHERE sentiment <> 'unknown') = 1 "
    "THEN max(sentiment) FILTER (WHERE sentiment <> 'unknown') ELSE 'mixed' END"
)
COUNTS = ", ".join(f"count(*) FILTER (WHERE vote = '{s}') AS {s}_count" for s in SENTIMENTS)

CATALOG = """
products AS (SELECT n_nationkey AS product_id, n_name AS product_name, n_regionkey AS category FROM nation),
reviews AS (
  SELECT o.o_orderkey AS review_id, c.c_nationkey AS product_id,
         o.o_orderpriority || ' order ' || o.o_orderkey AS review_text, o.o_orderdate AS created_at
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
lines AS (
  SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
         l_shipdate, l_extendedprice, l_tax, l_discount)::INTEGER AS unit_position
  FROM lineitem l),
units AS (
  SELECT l.l_orderkey || '-' || l.unit_position AS opinion_unit_id,
    CASE WHEN l.l_linestatus = 'F' THEN l.l_orderkey * 100 + l.unit_position END AS source_opinion_unit_idx,
    l.l_orderkey AS review_id, l.unit_position, p.p_name AS raw_aspect,
    CASE WHEN p.p_type <> 'PROMO' THEN p.p_type || '/' || l.l_linestatus END AS raw_status,
    'order ' || l.l_orderkey AS excerpt, p.p_name || ' ' || lower(p.p_type) AS opinion,
    CASE WHEN l.l_tax >= 0.08 THEN 'unknown' WHEN l.l_returnflag = 'R' THEN 'negative'
         WHEN l.l_returnflag = 'N' THEN 'positive' WHEN l.l_discount >= 0.06 THEN 'mixed'
         ELSE 'neutral' END AS sentiment,
    CASE WHEN split_part(p.p_name, ' ', -1) = 'anvil' THEN 'excluded_taxonomy'
         WHEN l.l_quantity > 45 THEN 'candidate' ELSE 'mapped_exact' END AS mapping_state,
    split_part(p.p_name, ' ', -1) AS aspect_id, split_part(p.p_name, ' ', -1) AS aspect,
    CASE WHEN p.p_type <> 'PROMO' THEN split_part(p.p_name, ' ', -1) || ':' || p.p_type END AS status_id,
    CASE WHEN p.p_type <> 'PROMO' THEN p.p_type END AS status,
    l.l_discount AS aspect_distance, CASE WHEN p.p_type <> 'PROMO' THEN l.l_tax END AS status_distance
  FROM lines l JOIN part p ON l.l_partkey = p.p_partkey),
catalog AS (SELECT u.*, v.product_id, v.review_text, v.created_at FROM units u JOIN reviews v USING (review_id)),
fact AS (SELECT * FROM catalog WHERE mapping_state = 'mapped_exact'),
review_counts AS (
  SELECT p.product_id, p.product_name, count(DISTINCT v.review_id) AS review_count
  FROM products p LEFT JOIN reviews v USING (product_id) GROUP BY ALL)"""

VOTES = f""",
av AS (SELECT product_id, review_id, aspect_id, aspect, {COLLAPSE} AS vote FROM fact GROUP BY 1, 2, 3, 4),
pv AS (SELECT product_id, review_id, aspect_id, status_id, aspect, status, {COLLAPSE} AS vote
       FROM fact GROUP BY 1, 2, 3, 4, 5, 6)"""


def wilson(successes: str, total: str, side: str) -> str:
    p = f"({successes}::DOUBLE / nullif({total}, 0))"
    centre = f"({p} + {Z} * {Z} / (2 * {total}))"
    margin = f"({Z} * sqrt(({p} * (1 - {p}) + {Z} * {Z} / (4 * {total})) / {total}))"
    denominator = f"(1 + {Z} * {Z} / {total})"
    if side == "lower":
        return f"greatest(0.0::DOUBLE, ({centre} - {margin}) / {denominator})"
    return f"least(1.0::DOUBLE, ({centre} + {margin}) / {denominator})"


def distribution(total: str = "supporting_review_count", prefix: str = "", source: str = "") -> str:
    n = f"nullif({total}, 0)"
    c = {s: f"{source}{s}_count" for s in SENTIMENTS}
    parts = [f"{r(f'{c[s]}::DOUBLE / {n}')} AS {prefix}{s}_share" for s in SENTIMENTS]
    top = f"greatest({', '.join(c.values())})"
    cases = " ".join(f"WHEN {c[s]} = {top} THEN '{s}'" for s in SENTIMENTS)
    parts.append(f"CASE WHEN {total} = 0 THEN NULL {cases} END AS {prefix}dominant_sentiment")
    parts.append(f"{r(f'{top}::DOUBLE / {n}')} AS {prefix}dominant_share")
    for s in ("positive", "negative"):
        for side in ("lower", "upper"):
            bound = wilson(c[s], total, side)
            parts.append(
                f"CASE WHEN {total} > 0 THEN {r(bound)} END AS {prefix}{s}_wilson_{side}"
            )
    terms = " + ".join(
        f"CASE WHEN {c[s]} > 0 THEN -({c[s]}::DOUBLE / {n}) * log2({c[s]}::DOUBLE / {n}) ELSE 0 END"
        for s in SENTIMENTS
    )
    parts.append(
        f"CASE WHEN {total} > 0 THEN {r(f'({terms}) / log2(5.0::DOUBLE)')} END "
        f"AS {prefix}normalized_entropy"
    )
    return ", ".join(parts)


ASPECT_ORDER = "supporting_review_count DESC, aspect, aspect_id"
PAIR_ORDER = (
    "supporting_review_count DESC, aspect, coalesce(status, ''), aspect_id, coalesce(status_id, '')"
)


def matrix(votes: str, keys: str, order: str) -> str:
    return f"""
SELECT m.*, {distribution()}, {r('supporting_review_count::DOUBLE / review_count')} AS mention_rate,
       row_number() OVER (PARTITION BY product_id ORDER BY {order})::INTEGER AS rank
FROM (SELECT v.product_id, {keys}, count(*) AS supporting_review_count, {COUNTS},
             any_value(c.product_name) AS product_name, any_value(c.review_count) AS review_count
      FROM {votes} v JOIN review_counts c USING (product_id) GROUP BY v.product_id, {keys}) m"""


ASPECT_MATRIX = matrix("av", "aspect_id, aspect", ASPECT_ORDER)
PAIR_MATRIX = matrix("pv", "aspect_id, status_id, aspect, status", PAIR_ORDER)


CUSTOMER_CATALOG = CATALOG.replace(
    "SELECT n_nationkey AS product_id, n_name AS product_name, n_regionkey AS category FROM nation",
    "SELECT c_custkey AS product_id, c_name AS product_name, c_mktsegment AS category FROM customer",
).replace("c.c_nationkey AS product_id", "c.c_custkey AS product_id")


def base(body: str, votes: bool = True, extra: str = "", by_customer: bool = False) -> str:
    catalog = CUSTOMER_CATALOG if by_customer else CATALOG
    return f"WITH {catalog}{VOTES if votes else ''}{extra}\n{body}"


def stats(keys: str, part: str) -> str:
    d = f"{part}_distance"
    return f"""SELECT {keys}, count(*) AS eligible_opinion_unit_count, count({d}) AS mapped_opinion_unit_count,
  {r(f'count({d})::DOUBLE / count(*)')} AS mapping_rate, {r(f'quantile_cont({d}, 0.5)')} AS distance_p50,
  {r(f'quantile_cont({d}, 0.95)')} AS distance_p95, {r(f'max({d})')} AS distance_max
FROM fact GROUP BY {keys}"""


def evidence(keys: str, limit: int) -> str:
    d = "coalesce(aspect_distance, 0) + coalesce(status_distance, 0)"
    tail = f"{d}, source_opinion_unit_idx ASC NULLS LAST, unit_position, opinion_unit_id"
    return f"""
SELECT product_id, {keys}, review_vote_sentiment, evidence_rank, review_id, opinion_unit_id, sentiment
FROM (SELECT *, row_number() OVER (PARTITION BY product_id, {keys}, review_vote_sentiment
        ORDER BY sentiment <> review_vote_sentiment, {tail})::INTEGER AS evidence_rank
      FROM (SELECT f.*, v.vote AS review_vote_sentiment, row_number() OVER (
              PARTITION BY f.product_id, f.review_id, {', '.join('f.' + k.strip() for k in keys.split(','))}
              ORDER BY f.sentiment <> v.vote, {tail}) AS unit_rank
            FROM fact f JOIN grain_votes v ON f.product_id = v.product_id AND f.review_id = v.review_id
             AND {' AND '.join(f'f.{k.strip()} IS NOT DISTINCT FROM v.{k.strip()}' for k in keys.split(','))})
      WHERE unit_rank = 1)
WHERE evidence_rank <= {limit}"""


ORACLES: dict[str, str] = {}

ORACLES["aspect_sentiment_matrix"] = base(ASPECT_MATRIX)
ORACLES["aspect_status_matrix"] = base(PAIR_MATRIX)
ORACLES["mapping_stats_by_aspect"] = base(stats("product_id, aspect_id, aspect", "aspect"), False)
ORACLES["mapping_stats_by_pair"] = base(
    stats("product_id, aspect_id, status_id, aspect, status", "status"), False
)
_UNITS_DIST = f"""SELECT product_id, count(*) AS supporting_review_count, {COUNTS}
  FROM (SELECT product_id, sentiment AS vote FROM fact) GROUP BY 1"""
_VOTES_DIST = f"SELECT product_id, count(*) AS supporting_review_count, {COUNTS} FROM av GROUP BY 1"
ORACLES["sentiment_entropy"] = base(
    f"""SELECT 'opinion_unit' AS scope, d.*, {distribution()} FROM ({_UNITS_DIST}) d
UNION ALL SELECT 'review_aspect_vote' AS scope, d.*, {distribution()} FROM ({_VOTES_DIST}) d"""
)
ORACLES["normalization_reduction"] = base(
    f"""SELECT c.*, {r('(raw_aspect_count - aspect_count)::DOUBLE / nullif(raw_aspect_count, 0)')} AS aspect_decrease_rate,
  {r('(raw_status_count - status_count)::DOUBLE / nullif(raw_status_count, 0)')} AS status_decrease_rate,
  {r('(raw_pair_count - pair_count)::DOUBLE / nullif(raw_pair_count, 0)')} AS pair_decrease_rate
FROM (SELECT product_id, count(DISTINCT raw_aspect) AS raw_aspect_count, count(DISTINCT aspect_id) AS aspect_count,
  count(DISTINCT aspect_id || '|' || raw_status) AS raw_status_count, count(DISTINCT status_id) AS status_count,
  count(DISTINCT raw_aspect || '|' || coalesce(raw_status, '')) AS raw_pair_count,
  count(DISTINCT aspect_id || '|' || coalesce(status_id, '')) AS pair_count
  FROM fact GROUP BY product_id) c""",
    False,
)
ORACLES["coverage_by_product"] = base(
    f"""SELECT c.product_id, c.product_name, c.category, c.review_count,
  opinion_unit_count, covered_review_count, excluded_opinion_unit_count, excluded_review_count,
  candidate_opinion_unit_count, review_aspect_vote_count, unique_aspect_count,
  review_aspect_status_vote_count, unique_aspect_status_count,
  {r('covered_review_count::DOUBLE / nullif(review_count, 0)')} AS review_coverage_rate,
  {r('opinion_unit_count::DOUBLE / nullif(covered_review_count, 0)')} AS mean_units_per_covered_review
FROM (SELECT p.product_id, p.product_name, p.category, count(DISTINCT v.review_id) AS review_count
      FROM products p LEFT JOIN reviews v USING (product_id) GROUP BY ALL) c
JOIN (SELECT product_id, count(*) FILTER (WHERE mapping_state = 'mapped_exact') AS opinion_unit_count,
  count(DISTINCT review_id) FILTER (WHERE mapping_state = 'mapped_exact') AS covered_review_count,
  count(*) FILTER (WHERE mapping_state = 'excluded_taxonomy') AS excluded_opinion_unit_count,
  count(DISTINCT review_id) FILTER (WHERE mapping_state = 'excluded_taxonomy') AS excluded_review_count,
  count(*) FILTER (WHERE mapping_state = 'candidate') AS candidate_opinion_unit_count
  FROM catalog GROUP BY 1) u USING (product_id)
JOIN (SELECT product_id, count(*) AS review_aspect_vote_count, count(DISTINCT aspect_id) AS unique_aspect_count
  FROM av GROUP BY 1) a USING (product_id)
JOIN (SELECT product_id, count(*) AS review_aspect_status_vote_count,
  count(DISTINCT aspect_id || '|' || coalesce(status_id, '')) AS unique_aspect_status_count FROM pv GROUP BY 1) s
  USING (product_id)"""
)
ORACLES["product_review_counts"] = base(
    "SELECT product_id, product_name, category, count(DISTINCT review_id) AS review_count "
    "FROM products LEFT JOIN reviews USING (product_id) GROUP BY ALL",
    False,
)
ORACLES["evidence_top_aspect"] = base(
    evidence("aspect_id, aspect", 3), True, ", grain_votes AS (SELECT * FROM av)"
)
ORACLES["evidence_top_pair"] = base(
    evidence("aspect_id, status_id, aspect, status", 2), True, ", grain_votes AS (SELECT * FROM pv)"
)
ORACLES["latest_review"] = base(
    """SELECT l.product_id, l.review_id, l.created_at, u.unit_position, u.raw_aspect, u.aspect, u.raw_status,
  u.status, u.excerpt, u.opinion, u.sentiment
FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY created_at DESC, review_id DESC) AS n
      FROM reviews) l LEFT JOIN units u USING (review_id) WHERE n = 1""",
    False,
)
ORACLES["most_debated_aspect"] = base(
    f"""SELECT product_id, aspect_id, aspect, supporting_review_count, positive_share, negative_share,
  {r('gap')} AS positive_negative_rate_gap, 'top_10_aspect_summary' AS selection_scope
FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY gap, supporting_review_count DESC, aspect, aspect_id) AS n
  FROM (SELECT *, abs(coalesce(positive_share, 0) - coalesce(negative_share, 0)) AS gap FROM ({ASPECT_MATRIX})
        WHERE rank <= 10 AND positive_count + negative_count > 0)) WHERE n = 1"""
)
ORACLES["top_negative_row"] = base(
    f"""SELECT product_id, aspect_id, status_id, negative_count, negative_share, supporting_review_count, rank
FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY negative_count DESC, negative_share DESC,
  supporting_review_count DESC, rank) AS n FROM ({PAIR_MATRIX}) WHERE negative_count > 0) WHERE n = 1"""
)
ORACLES["unit_votes"] = base(
    f"""SELECT f.opinion_unit_id, f.sentiment, v.vote AS review_vote_sentiment
FROM fact f JOIN av v ON f.review_id = v.review_id AND f.product_id = v.product_id AND f.aspect_id = v.aspect_id"""
)
ORACLES["quality_flags"] = base(
    """SELECT p.product_id, f.code, f.severity, f.value, f.implication
FROM products p LEFT JOIN (SELECT product_id, count(*) AS n FROM catalog WHERE mapping_state = 'candidate' GROUP BY 1) c
  USING (product_id),
LATERAL (SELECT 'PENDING_MAPPING_CANDIDATES' AS code,
    CASE WHEN coalesce(c.n, 0) > 0 THEN 'warning' ELSE 'info' END AS severity,
    CAST(coalesce(c.n, 0) AS VARCHAR) AS value, 'excluded_from_canonical_report_aggregation' AS implication
  UNION ALL SELECT 'COMMERCE_CONTEXT_UNAVAILABLE', 'warning', 'price,inventory,shipping,promotion',
    'review_experience_only_not_purchase_optimality') f""",
    False,
)

# --- profiles -------------------------------------------------------------------------------
NET = f"""net AS (SELECT product_id, aspect_id,
  {r("avg(CASE vote WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -1.0 ELSE 0.0 END::DOUBLE)")} AS net_sentiment
  FROM av GROUP BY 1, 2)"""
ORACLES["net_sentiment_profile"] = base("SELECT * FROM net", True, ", " + NET)
ORACLES["profile_similarity_l1"] = base(
    f"""SELECT left_id, right_id, coalesce(c.common, 0) AS common_aspect_count,
  coalesce({r('0.7::DOUBLE * (1 - c.l1 / (2.0::DOUBLE * c.common)) + 0.3::DOUBLE * (c.common::DOUBLE / (nl.n + nr.n - c.common))')}, 0.0::DOUBLE) AS profile_similarity
FROM pairs LEFT JOIN (SELECT p.left_id, p.right_id, count(*) AS common, sum(abs(a.net_sentiment - b.net_sentiment)) AS l1
  FROM pairs p JOIN net a ON a.product_id = p.left_id JOIN net b ON b.product_id = p.right_id AND a.aspect_id = b.aspect_id
  GROUP BY 1, 2) c USING (left_id, right_id)
LEFT JOIN (SELECT product_id AS left_id, count(*) AS n FROM net GROUP BY 1) nl USING (left_id)
LEFT JOIN (SELECT product_id AS right_id, count(*) AS n FROM net GROUP BY 1) nr USING (right_id)""",
    True,
    ", "
    + NET
    + """, pairs AS (SELECT DISTINCT a.product_id AS left_id, b.product_id AS right_id FROM net a JOIN net b
  ON a.aspect_id = b.aspect_id AND a.product_id <> b.product_id)""",
)
KNOWN = ("positive", "negative", "mixed", "neutral")
PROFILE = f"""
acounts AS (SELECT product_id, aspect_id, aspect, count(*) AS n, {COUNTS} FROM av GROUP BY 1, 2, 3),
prior AS (SELECT aspect_id, {', '.join(f"CASE WHEN count(*) FILTER (WHERE vote <> 'unknown') > 0 THEN count(*) FILTER (WHERE vote = '{s}')::DOUBLE / count(*) FILTER (WHERE vote <> 'unknown') ELSE 0.25 END AS {s}_prior" for s in KNOWN)}
  FROM av GROUP BY 1),
profile AS (SELECT a.product_id, a.aspect_id, a.aspect, a.n AS supporting_review_count,
  a.n::DOUBLE / c.review_count AS mention_rate, a.n::DOUBLE / (a.n + 5) AS support_reliability,
  {', '.join(f"sqrt(a.n::DOUBLE / c.review_count) * (a.n::DOUBLE / (a.n + 5)) * (1 - a.unknown_count::DOUBLE / a.n) * (a.{s}_count + 5 * p.{s}_prior) / (a.n - a.unknown_count + 5.0::DOUBLE) AS {s}_value" for s in KNOWN)}
  FROM acounts a JOIN prior p USING (aspect_id) JOIN review_counts c USING (product_id)),
rates AS (SELECT v.product_id, v.aspect_id, v.status_id, count(*)::DOUBLE / any_value(c.review_count) AS rate
  FROM pv v JOIN review_counts c USING (product_id) GROUP BY 1, 2, 3)"""
ORACLES["category_prior"] = base(
    f"""SELECT aspect_id, {', '.join(f"{r(s + '_prior')} AS {s}_prior" for s in KNOWN)} FROM prior""",
    True,
    "," + PROFILE,
)
ORACLES["smoothed_profile"] = base(
    f"""SELECT product_id, aspect_id, aspect, supporting_review_count, {r('mention_rate')} AS mention_rate,
  {r('support_reliability')} AS support_reliability, {', '.join(f"{r(s + '_value')} AS {s}_value" for s in KNOWN)}
FROM profile""",
    True,
    "," + PROFILE,
)
PAIR_PROFILES = f""",
pp AS (SELECT m.*, {distribution()}, least(1.0::DOUBLE, supporting_review_count / 2.0::DOUBLE) AS support_reliability
  FROM (SELECT product_id, aspect_id, status_id, aspect, status, count(*) AS supporting_review_count, {COUNTS}
        FROM pv WHERE status_id IS NOT NULL GROUP BY 1, 2, 3, 4, 5) m)"""
ORACLES["pair_profiles"] = base("SELECT * FROM pp", True, PAIR_PROFILES)

# --- similarity and repair --------------------------------------------------------------------
SIMILARITY = f"""
, pairs2 AS (SELECT a.product_id AS source_id, b.product_id AS candidate_id, b.product_name AS candidate_name,
    b.review_count AS catalog_review_count
  FROM review_counts a JOIN review_counts b ON a.product_id <> b.product_id),
sums AS (SELECT product_id, sum(mention_rate) AS mention,
  sum({' + '.join(f'{s}_value * {s}_value' for s in KNOWN)}) AS square FROM profile GROUP BY 1),
rate_sums AS (SELECT product_id, sum(rate) AS rates FROM rates GROUP BY 1),
shared AS (SELECT a.product_id AS source_id, b.product_id AS candidate_id,
    sum(least(a.mention_rate, b.mention_rate)) AS low,
    sum(least(a.mention_rate, b.mention_rate) * sqrt(a.support_reliability * b.support_reliability)) AS reliable,
    sum(sqrt(a.mention_rate * b.mention_rate)) AS mention_dot,
    sum({' + '.join(f'a.{s}_value * b.{s}_value' for s in KNOWN)}) AS channel_dot
  FROM profile a JOIN profile b ON a.aspect_id = b.aspect_id AND a.product_id <> b.product_id GROUP BY 1, 2),
shared_rates AS (SELECT a.product_id AS source_id, b.product_id AS candidate_id, sum(least(a.rate, b.rate)) AS rate_low
  FROM rates a JOIN rates b ON a.aspect_id = b.aspect_id AND a.status_id IS NOT DISTINCT FROM b.status_id
   AND a.product_id <> b.product_id GROUP BY 1, 2),
components AS (SELECT p.*, s.low / (x.mention + y.mention - s.low) AS overlap, s.reliable / s.low AS reliability,
    s.channel_dot / (sqrt(x.square) * sqrt(y.square)) AS cosine,
    s.mention_dot / (sqrt(x.mention) * sqrt(y.mention)) AS mention_cosine,
    q.rate_low / (v.rates + w.rates - q.rate_low) AS status_overlap
  FROM pairs2 p LEFT JOIN shared s USING (source_id, candidate_id) LEFT JOIN shared_rates q USING (source_id, candidate_id)
  LEFT JOIN sums x ON x.product_id = source_id LEFT JOIN sums y ON y.product_id = candidate_id
  LEFT JOIN rate_sums v ON v.product_id = source_id LEFT JOIN rate_sums w ON w.product_id = candidate_id),
similar_pairs AS (SELECT *, coalesce({r('cosine * sqrt(overlap)')}, 0.0::DOUBLE) AS experience_similarity FROM components),
ranked_similar AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY experience_similarity DESC, candidate_name)::INTEGER AS rank
  FROM similar_pairs)"""
FULL = "," + PROFILE + PAIR_PROFILES + SIMILARITY
ORACLES["similar_products"] = base(
    f"""SELECT source_id, candidate_id, candidate_name, rank, catalog_review_count, experience_similarity,
  experience_similarity AS pair_similarity, {r('coalesce(mention_cosine, 0)')} AS aspect_mention_similarity,
  {r('coalesce(cosine, 0)')} AS aspect_sentiment_similarity, {r('coalesce(overlap, 0)')} AS evidence_overlap,
  {r('coalesce(reliability, 0)')} AS support_reliability, {r('coalesce(status_overlap, 0)')} AS aspect_status_exact_overlap,
  concat_ws(',', CASE WHEN coalesce(overlap, 0) < 0.2 THEN 'LOW_EVIDENCE_OVERLAP' END,
    CASE WHEN coalesce(reliability, 0) < 0.5 THEN 'LOW_SHARED_SUPPORT_RELIABILITY' END) AS quality_codes
FROM ranked_similar WHERE rank <= 3""",
    True,
    FULL,
)
ORACLES["shared_aspects_top5"] = base(
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, candidate_id
    ORDER BY shared_mention_weight DESC, aspect, aspect_id)::INTEGER AS rank
  FROM (SELECT s.source_id, s.candidate_id, a.aspect_id, a.aspect, {r('a.mention_rate')} AS source_mention_rate,
    {r('b.mention_rate')} AS candidate_mention_rate, {r('least(a.mention_rate, b.mention_rate)')} AS shared_mention_weight
    FROM ranked_similar s JOIN profile a ON a.product_id = s.source_id
    JOIN profile b ON b.product_id = s.candidate_id AND a.aspect_id = b.aspect_id WHERE s.rank <= 3)) WHERE rank <= 5""",
    True,
    FULL,
)
WEAK = f"""
, pair_matrix AS ({PAIR_MATRIX}),
weak AS (SELECT *, 'weakness_' || position AS condition_id FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY importance DESC, negative_count DESC,
    supporting_review_count DESC, aspect, status)::INTEGER AS position
  FROM (SELECT product_id, aspect_id, status_id, aspect, status, negative_count, supporting_review_count,
    {r('negative_count::DOUBLE / supporting_review_count')} AS negative_rate,
    {r('negative_count::DOUBLE / supporting_review_count * supporting_review_count / (supporting_review_count + 5.0::DOUBLE)')} AS importance
    FROM pair_matrix WHERE negative_count > 0 AND status_id IS NOT NULL AND supporting_review_count >= 2)) WHERE position <= 10)"""
ORACLES["source_weaknesses"] = base("SELECT * FROM weak", True, WEAK)
ORACLES["excluded_weaknesses"] = base(
    """SELECT product_id, aspect, status, CASE WHEN status_id IS NULL THEN 'STATUS_CLUSTER_ID_UNAVAILABLE'
  ELSE 'SOURCE_NEGATIVE_SUPPORT_BELOW_MINIMUM' END AS reason, negative_count, supporting_review_count
FROM pair_matrix WHERE negative_count > 0 AND (status_id IS NULL OR supporting_review_count < 2)""",
    True,
    WEAK,
)


def repair(against: str) -> str:
    """CTEs ranking candidates for ``conditions`` (request_id, source_id, condition_id, ..., importance)."""
    return f"""
, strengths AS (SELECT *, {against} AS against,
    CASE WHEN dominant_sentiment = 'positive' THEN support_reliability * positive_wilson_lower END AS favour FROM pp),
keys AS (SELECT DISTINCT aspect_id, status_id FROM conditions),
options AS (SELECT k.aspect_id, k.status_id, s.product_id AS candidate_id, s.status AS best_status, s.status_id AS best_status_id,
    s.favour, s.positive_count AS best_positive_count, row_number() OVER (PARTITION BY k.aspect_id, k.status_id, s.product_id
      ORDER BY s.favour DESC, s.supporting_review_count DESC, s.status, s.status_id) AS n
  FROM keys k JOIN strengths s ON s.aspect_id = k.aspect_id AND s.status_id <> k.status_id WHERE s.favour IS NOT NULL),
evaluated AS (SELECT k.aspect_id, k.status_id, p.product_id AS candidate_id, t.against, t.negative_count AS target_negative_count,
    t.supporting_review_count AS target_support, o.favour, o.best_status, o.best_status_id, o.best_positive_count,
    {r('coalesce(o.favour, 0) - coalesce(t.against, 0)')} AS utility
  FROM keys k CROSS JOIN products p
  LEFT JOIN strengths t ON t.product_id = p.product_id AND t.aspect_id = k.aspect_id AND t.status_id = k.status_id
  LEFT JOIN options o ON o.candidate_id = p.product_id AND o.aspect_id = k.aspect_id AND o.status_id = k.status_id AND o.n = 1),
scored AS (SELECT c.request_id, c.source_id, e.candidate_id, sum(c.importance * e.utility) / sum(c.importance) AS u,
    count(*) FILTER (WHERE e.against IS NOT NULL OR e.favour IS NOT NULL) AS supported, count(*) AS n
  FROM conditions c JOIN evaluated e USING (aspect_id, status_id) WHERE e.candidate_id <> c.source_id GROUP BY 1, 2, 3),
repaired AS (SELECT x.request_id, x.source_id, x.candidate_id, s.candidate_name, {settled('x.u')} AS utility, s.experience_similarity,
    {settled('0.25::DOUBLE * s.experience_similarity + 0.75::DOUBLE * ((x.u + 1) / 2)')} AS score,
    {r('x.supported::DOUBLE / x.n')} AS evidence_coverage, x.supported::INTEGER AS supported_count
  FROM scored x JOIN similar_pairs s USING (source_id, candidate_id) WHERE x.supported > 0),
top_repairs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id
    ORDER BY score DESC, utility DESC, experience_similarity DESC, candidate_name)::INTEGER AS rank FROM repaired) WHERE rank <= 3)"""


STATIC_CONDITIONS = """
, conditions AS (SELECT product_id AS request_id, product_id AS source_id, condition_id, aspect_id, status_id, aspect,
  status, importance FROM weak)"""
STATIC = FULL + WEAK + STATIC_CONDITIONS + repair("support_reliability")
MATCHES = """SELECT t.request_id, t.candidate_id, c.condition_id, t.rank, c.aspect_id, c.status_id, c.aspect, c.status,
  CASE WHEN e.against IS NOT NULL AND e.favour IS NOT NULL THEN 'EXACT_UNDESIRED_STATUS_AND_POSITIVE_ALTERNATIVE'
    WHEN e.against IS NOT NULL THEN 'EXACT_UNDESIRED_STATUS_ONLY'
    WHEN e.favour IS NOT NULL THEN 'POSITIVE_ALTERNATIVE_ONLY' ELSE 'NO_EVIDENCE' END AS relation,
  e.utility, e.target_support, e.best_status_id AS positive_status_id,
  concat_ws('; ', CASE WHEN e.against IS NOT NULL
      THEN chr(39) || c.aspect || ' ' || c.status || chr(39) || ' 부정 근거 ' || e.target_negative_count || '개'
      ELSE chr(39) || c.aspect || ' ' || c.status || chr(39) || ' 부정 상태 미관측' END,
    chr(39) || c.aspect || ' ' || e.best_status || chr(39) || ' 긍정 근거 ' || e.best_positive_count || '개') AS reason
FROM top_repairs t JOIN conditions c USING (request_id)
JOIN evaluated e ON e.candidate_id = t.candidate_id AND e.aspect_id = c.aspect_id AND e.status_id = c.status_id"""
ORACLES["weakness_repair_static"] = base("SELECT * FROM top_repairs", True, STATIC)
ORACLES["condition_matches_static"] = base(MATCHES, True, STATIC)

# --- submitted reviews ------------------------------------------------------------------------
GROUPS = f"""
, sgroups AS (SELECT review_id AS submission_id, product_id, aspect_id, status_id, aspect, status,
    {COLLAPSE} AS submitted_sentiment, 1::BIGINT AS submitted_review_vote_count,
    string_agg(opinion_unit_id, ',' ORDER BY unit_position) AS submitted_opinion_unit_ids,
    row_number() OVER (PARTITION BY review_id ORDER BY min(unit_position))::INTEGER AS rank
  FROM fact GROUP BY review_id, product_id, aspect_id, status_id, aspect, status)"""
OTHER_COUNTS = ", ".join(
    f"count(*) FILTER (WHERE v.vote = '{s}' AND v.review_id <> g.submission_id) AS other_{s}_count"
    for s in SENTIMENTS
)
RELATIONS = (
    GROUPS
    + f"""
, compared AS (
  SELECT g.*, 'aspect_status' AS comparison_grain, count(v.review_id) AS same_status_review_count,
    count(*) FILTER (WHERE v.review_id <> g.submission_id) AS other_supporting_review_count, {OTHER_COUNTS}
  FROM sgroups g LEFT JOIN pv v ON v.product_id = g.product_id AND v.aspect_id = g.aspect_id AND v.status_id = g.status_id
  WHERE g.status_id IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT g.*, 'aspect' AS comparison_grain, count(v.review_id) AS same_status_review_count,
    count(*) FILTER (WHERE v.review_id <> g.submission_id) AS other_supporting_review_count, {OTHER_COUNTS}
  FROM sgroups g LEFT JOIN av v ON v.product_id = g.product_id AND v.aspect_id = g.aspect_id
  WHERE g.status_id IS NULL GROUP BY ALL),
relations AS (SELECT *, CASE WHEN other_supporting_review_count = 0 THEN 'NOT_MENTIONED_BY_OTHER_REVIEWS'
    WHEN submitted_sentiment NOT IN ('positive', 'negative') OR other_dominant_sentiment NOT IN ('positive', 'negative')
      THEN 'INSUFFICIENT_OR_NON_DIRECTIONAL_OTHER_REVIEW_EVIDENCE'
    WHEN submitted_sentiment = other_dominant_sentiment THEN 'ALIGNS_WITH_OTHER_REVIEW_MAJORITY'
    ELSE 'CONTRADICTS_OTHER_REVIEW_MAJORITY' END AS relation_code
  FROM (SELECT c.*, {distribution('other_supporting_review_count', 'other_', 'other_')}, a.aspect_review_count,
          r.review_count AS catalog_review_count
        FROM compared c JOIN (SELECT product_id, aspect_id, count(*) AS aspect_review_count FROM av GROUP BY 1, 2) a
          USING (product_id, aspect_id) JOIN review_counts r USING (product_id)))"""
)
ORACLES["submitted_relationships"] = base(
    """SELECT *, CASE relation_code WHEN 'ALIGNS_WITH_OTHER_REVIEW_MAJORITY' THEN '일치합니다'
  WHEN 'CONTRADICTS_OTHER_REVIEW_MAJORITY' THEN '일치하지 않습니다' ELSE '판단하기 어렵습니다' END AS relation_label
FROM relations""",
    True,
    RELATIONS,
    by_customer=True,
)
ORACLES["unmentioned_pairs"] = base(
    """SELECT submission_id, product_id, aspect_id, status_id, aspect, status, rank, submitted_opinion_unit_ids
FROM relations WHERE status_id IS NOT NULL AND other_supporting_review_count = 0""",
    True,
    RELATIONS,
    by_customer=True,
)
ORACLES["other_top_statuses"] = base(
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY submission_id, product_id, aspect_id, status_id
    ORDER BY supporting_review_count DESC, other_status, other_status_id)::INTEGER AS rank
  FROM (SELECT u.submission_id, u.product_id, u.aspect_id, u.status_id, v.status_id AS other_status_id,
          v.status AS other_status, count(*) AS supporting_review_count, {COUNTS}
        FROM relations u JOIN pv v ON v.product_id = u.product_id AND v.aspect_id = u.aspect_id
         AND v.review_id <> u.submission_id AND v.status_id IS NOT NULL
        WHERE u.status_id IS NOT NULL AND u.other_supporting_review_count = 0 GROUP BY 1, 2, 3, 4, 5, 6)) WHERE rank <= 3""",
    True,
    RELATIONS,
    by_customer=True,
)
ORACLES["comparison_summary"] = base(
    """SELECT review_id AS submission_id, count(*) AS submitted_opinion_unit_count,
  count(*) FILTER (WHERE mapping_state = 'mapped_exact') AS exact_mapped_opinion_unit_count,
  count(DISTINCT aspect_id || '|' || status_id) FILTER (WHERE mapping_state = 'mapped_exact') AS exact_mapped_aspect_status_count,
  count(*) FILTER (WHERE mapping_state <> 'mapped_exact') AS unresolved_opinion_unit_count,
  count(*) FILTER (WHERE mapping_state = 'candidate') AS candidate_opinion_unit_count
FROM catalog GROUP BY 1""",
    False,
)
ORACLES["unresolved_units"] = base(
    """SELECT review_id AS submission_id, opinion_unit_id, raw_aspect, raw_status, mapping_state,
  CASE mapping_state WHEN 'candidate' THEN 'CANDIDATE_HAS_NO_CANONICAL_ASPECT_STATUS' ELSE 'EXCLUDED_FROM_TAXONOMY' END AS reason
FROM catalog WHERE mapping_state <> 'mapped_exact'""",
    False,
)
CONDITIONS = (
    GROUPS
    + """
, sconditions AS (SELECT *, 'condition_' || position AS condition_id FROM (
  SELECT submission_id, product_id, aspect_id, status_id, aspect, status,
    row_number() OVER (PARTITION BY submission_id ORDER BY rank)::INTEGER AS position,
    submitted_review_vote_count::DOUBLE AS importance, submitted_opinion_unit_ids
  FROM sgroups WHERE submitted_sentiment = 'negative' AND status_id IS NOT NULL)),
sexcluded AS (SELECT submission_id, split_part(submitted_opinion_unit_ids, ',', 1) AS opinion_unit_id, aspect, status,
    'mapped_exact' AS mapping_state, 'NEGATIVE_INPUT_HAS_NO_STATUS_CLUSTER_ID' AS reason
  FROM sgroups WHERE submitted_sentiment = 'negative' AND status_id IS NULL
  UNION ALL SELECT review_id, opinion_unit_id, raw_aspect, raw_status, mapping_state,
    'NEGATIVE_INPUT_HAS_NO_CANONICAL_ASPECT_STATUS' FROM catalog WHERE sentiment = 'negative' AND mapping_state <> 'mapped_exact')"""
)
ORACLES["negative_conditions"] = base("SELECT * FROM sconditions", True, CONDITIONS, by_customer=True)
ORACLES["excluded_negative_conditions"] = base("SELECT * FROM sexcluded", True, CONDITIONS)
ORACLES["two_level_collapse"] = base(
    f"""SELECT product_id AS submission_id, aspect_id, status_id, aspect, status, count(*) AS submitted_review_vote_count,
  {COLLAPSE.replace('sentiment', 'vote')} AS submitted_sentiment FROM pv GROUP BY 1, 2, 3, 4, 5""",
    True,
    by_customer=True,
)
SUBMITTED = (
    FULL
    + CONDITIONS
    + """
, conditions AS (SELECT submission_id AS request_id, product_id AS source_id, condition_id, aspect_id, status_id, aspect,
  status, importance FROM sconditions)"""
    + repair("support_reliability * coalesce(negative_wilson_upper, 0)")
)
ORACLES["weakness_repair_submitted"] = base("SELECT * FROM top_repairs", True, SUBMITTED)
ORACLES["recommendation_status"] = base(
    """SELECT v.review_id AS submission_id, coalesce(a.n, 0) AS alternative_count, coalesce(c.n, 0) AS condition_count,
  coalesce(e.n, 0) AS excluded_condition_count,
  CASE WHEN a.n > 0 THEN 'COMPLETED' WHEN c.n > 0 THEN 'NO_CANDIDATE_WITH_REPAIR_EVIDENCE'
    WHEN e.n > 0 THEN 'NEGATIVE_INPUT_UNRESOLVED' ELSE 'NO_NEGATIVE_SUBMITTED_ASPECT_STATUS' END AS status
FROM reviews v LEFT JOIN (SELECT request_id, count(*) AS n FROM top_repairs GROUP BY 1) a ON a.request_id = v.review_id
LEFT JOIN (SELECT submission_id, count(*) AS n FROM sconditions GROUP BY 1) c ON c.submission_id = v.review_id
LEFT JOIN (SELECT submission_id, count(*) AS n FROM sexcluded GROUP BY 1) e ON e.submission_id = v.review_id""",
    True,
    SUBMITTED,
)

# --- requests and decisions -------------------------------------------------------------------
RESOLVE = """
, pairs AS (SELECT DISTINCT aspect_id, aspect, status_id, status FROM units WHERE mapping_state = 'mapped_exact'),
by_aspect AS (SELECT aspect, count(DISTINCT aspect_id) AS n, min(aspect_id) AS id FROM pairs GROUP BY 1),
by_status AS (SELECT aspect_id, status, count(DISTINCT status_id) AS n, min(status_id) AS id FROM pairs
  WHERE status_id IS NOT NULL GROUP BY 1, 2),
step1 AS (SELECT q.*, coalesce(q.aspect_cluster_id, CASE WHEN a.n = 1 THEN a.id END) AS resolved_aspect_id,
    CASE WHEN q.aspect_cluster_id IS NULL AND a.n IS NULL THEN 'ASPECT_LABEL_NOT_FOUND'
      WHEN q.aspect_cluster_id IS NULL AND a.n > 1 THEN 'ASPECT_LABEL_AMBIGUOUS'
      WHEN q.aspect_cluster_id IS NOT NULL AND i.aspect IS NULL THEN 'ASPECT_CLUSTER_ID_NOT_FOUND'
      WHEN i.aspect <> q.aspect THEN 'ASPECT_LABEL_CLUSTER_MISMATCH' END AS aspect_reason
  FROM requested q LEFT JOIN by_aspect a ON a.aspect = q.aspect
  LEFT JOIN (SELECT DISTINCT aspect_id, aspect FROM pairs) i ON i.aspect_id = q.aspect_cluster_id),
step2 AS (SELECT q.*, coalesce(q.status_cluster_id, CASE WHEN s.n = 1 THEN s.id END) AS resolved_status_id,
    coalesce(q.status, i.status) AS full_status,
    CASE WHEN q.resolved_aspect_id IS NOT NULL AND q.status IS NOT NULL AND q.status_cluster_id IS NULL AND s.n IS NULL THEN 'STATUS_LABEL_NOT_FOUND'
      WHEN q.resolved_aspect_id IS NOT NULL AND q.status IS NOT NULL AND q.status_cluster_id IS NULL AND s.n > 1 THEN 'STATUS_LABEL_AMBIGUOUS'
      WHEN q.status_cluster_id IS NOT NULL AND i.status IS NULL THEN 'STATUS_CLUSTER_ID_NOT_FOUND'
      WHEN q.status_cluster_id IS NOT NULL AND i.aspect_id <> q.resolved_aspect_id THEN 'STATUS_CLUSTER_ASPECT_MISMATCH' END AS status_reason,
    CASE WHEN q.status_cluster_id IS NOT NULL AND i.status <> q.status THEN 'STATUS_LABEL_CLUSTER_MISMATCH' END AS label_reason
  FROM step1 q LEFT JOIN by_status s ON s.aspect_id = q.resolved_aspect_id AND s.status = q.status
  LEFT JOIN (SELECT DISTINCT aspect_id, status_id, status FROM pairs WHERE status_id IS NOT NULL) i ON i.status_id = q.status_cluster_id),
resolved AS MATERIALIZED (SELECT * EXCLUDE (status, full_status, aspect_reason, status_reason, label_reason), full_status AS status,
    CASE WHEN sentiment IN ('positive', 'negative') AND coalesce(aspect_reason, status_reason, label_reason) IS NULL
        AND (resolved_aspect_id IS NULL OR resolved_status_id IS NULL) THEN 'ACTIONABLE_REQUIREMENT_HAS_NO_RESOLVED_PAIR'
      ELSE concat_ws(',', aspect_reason, status_reason, label_reason) END AS reasons FROM step2)"""
ORACLES["label_resolution"] = base(
    "SELECT * FROM resolved",
    False,
    """
, requested AS (SELECT review_id AS request_id, product_id AS source_id, 'r' || unit_position AS requirement_id,
    CASE WHEN mapping_state = 'mapped_exact' THEN aspect ELSE raw_aspect END AS aspect,
    CASE WHEN sentiment = 'mixed' THEN raw_status ELSE status END AS status, sentiment,
    CASE WHEN source_opinion_unit_idx IS NOT NULL THEN aspect_id END AS aspect_cluster_id,
    CASE WHEN unit_position = 1 THEN status_id WHEN unit_position = 2 THEN aspect || ':MEDIUM' END AS status_cluster_id,
    1.0::DOUBLE AS importance FROM catalog)"""
    + RESOLVE,
)
REVIEW_REQUESTS = (
    """
, requested AS (SELECT review_id AS request_id, product_id AS source_id,
    'r' || row_number() OVER (PARTITION BY review_id ORDER BY unit_position) AS requirement_id, aspect, status, sentiment,
    aspect_id AS aspect_cluster_id, status_id AS status_cluster_id, 1.0::DOUBLE AS importance, excerpt
  FROM fact)"""
    + RESOLVE
)
CLASHES = """
, clashes AS MATERIALIZED (SELECT request_id, resolved_aspect_id, resolved_status_id,
    string_agg(DISTINCT sentiment, ',' ORDER BY sentiment) AS sentiments FROM resolved
  WHERE resolved_aspect_id IS NOT NULL AND resolved_status_id IS NOT NULL GROUP BY 1, 2, 3
  HAVING count(*) FILTER (WHERE sentiment = 'positive') > 0 AND count(*) FILTER (WHERE sentiment = 'negative') > 0)"""
ORACLES["requirement_conflicts"] = base("SELECT * FROM clashes", True, REVIEW_REQUESTS + CLASHES)
NEAR = """
, vectors AS (SELECT s.aspect_id, s.status_id, s.status, e.embedding::DOUBLE[] AS embedding FROM (
    SELECT *, (row_number() OVER (ORDER BY status_id) - 1) % (SELECT max(vec_id) + 1 FROM embeddings) AS vec_id FROM (SELECT DISTINCT aspect_id, status_id, status
      FROM units WHERE mapping_state = 'mapped_exact' AND status_id IS NOT NULL)) s JOIN embeddings e USING (vec_id)),
near AS (SELECT a.aspect_id, a.status_id, b.status_id AS near_status_id, b.status AS near_status,
    1 - list_dot_product(a.embedding, b.embedding) / sqrt(list_dot_product(a.embedding, a.embedding) * list_dot_product(b.embedding, b.embedding)) AS d
  FROM vectors a JOIN vectors b ON a.aspect_id = b.aspect_id AND a.status_id <> b.status_id)"""
ORACLES["near_status_pairs"] = base(
    f"SELECT aspect_id, status_id, near_status_id, {r('d', 8)} AS distance FROM near WHERE d <= 0.9",
    False,
    NEAR,
)
DECISION = (
    REVIEW_REQUESTS
    + CLASHES
    + NEAR
    + f""",
dp AS MATERIALIZED (SELECT m.*, {distribution()}, {r('least(1.0::DOUBLE, supporting_review_count / 3.0::DOUBLE)')} AS support_reliability
  FROM (SELECT product_id, aspect_id, status_id, aspect, status, count(*) AS supporting_review_count, {COUNTS}
        FROM pv WHERE status_id IS NOT NULL GROUP BY 1, 2, 3, 4, 5) m),
wanted AS MATERIALIZED (SELECT request_id, source_id, resolved_aspect_id AS aspect_id, resolved_status_id AS status_id, sentiment, importance
  FROM resolved WHERE reasons = '' AND sentiment IN ('positive', 'negative')),
wanted_keys AS MATERIALIZED (SELECT DISTINCT aspect_id, status_id, sentiment FROM wanted),
close AS MATERIALIZED (SELECT DISTINCT aspect_id, status_id, status_id AS near_status_id, 0.0::DOUBLE AS d FROM wanted_keys
  UNION ALL SELECT aspect_id, status_id, near_status_id, {r('d', 8)} FROM near WHERE d <= 0.9),
matched AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY aspect_id, status_id, sentiment, candidate_id
    ORDER BY strength DESC, d, near_status_id) AS n FROM (
  SELECT k.*, p.product_id AS candidate_id, c.near_status_id, c.d, (1 - c.d / 0.9) * p.support_reliability AS strength,
    p.positive_wilson_lower AS lower_bound
  FROM wanted_keys k JOIN close c USING (aspect_id, status_id) JOIN dp p ON p.aspect_id = k.aspect_id AND p.status_id = c.near_status_id)),
favoured AS MATERIALIZED (SELECT k.aspect_id, k.status_id, k.sentiment, p.product_id AS candidate_id,
    max(p.support_reliability * p.positive_wilson_lower) AS favour
  FROM wanted_keys k JOIN dp p ON p.aspect_id = k.aspect_id AND p.dominant_sentiment = 'positive'
  LEFT JOIN close c ON c.aspect_id = k.aspect_id AND c.status_id = k.status_id AND c.near_status_id = p.status_id
  WHERE k.sentiment = 'negative' AND c.near_status_id IS NULL GROUP BY 1, 2, 3, 4),
contributions AS MATERIALIZED (SELECT aspect_id, status_id, sentiment, candidate_id,
    CASE sentiment WHEN 'positive' THEN sum(strength * lower_bound) ELSE coalesce(sum(favour), 0) - coalesce(sum(strength), 0) END AS value
  FROM (SELECT aspect_id, status_id, sentiment, candidate_id, strength, lower_bound, NULL AS favour FROM matched WHERE n = 1
    UNION ALL SELECT aspect_id, status_id, sentiment, candidate_id, NULL, NULL, favour FROM favoured) GROUP BY 1, 2, 3, 4),
asked AS MATERIALIZED (SELECT request_id, source_id, count(*) AS conditions, sum(importance) AS importance FROM wanted GROUP BY 1, 2),
supported AS MATERIALIZED (SELECT w.request_id, c.candidate_id, sum(w.importance * c.value) AS total, count(*) AS found
  FROM wanted w JOIN contributions c USING (aspect_id, status_id, sentiment) GROUP BY 1, 2),
dscores AS MATERIALIZED (SELECT a.request_id, a.source_id, p.product_id AS candidate_id, p.product_name AS candidate_name,
    {settled('coalesce(s.total, 0) / a.importance')} AS score,
    {r('coalesce(s.found, 0)::DOUBLE / a.conditions')} AS evidence_coverage, coalesce(s.found, 0)::INTEGER AS supported_count
  FROM asked a CROSS JOIN products p LEFT JOIN supported s ON s.request_id = a.request_id AND s.candidate_id = p.product_id
  WHERE p.product_id <> a.source_id),
dranked AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, candidate_name)::INTEGER AS rank
  FROM dscores) WHERE rank <= 2)"""
)
ORACLES["requirement_scores"] = base("SELECT * FROM dranked", True, DECISION)
ORACLES["decision_policy"] = base(
    f"""SELECT request_id, source_id, actionable_count, unresolved_count, coalesce(conflict_count, 0) AS conflict_count, top_product_name, top_score, top_coverage,
  runner_up_product_name, runner_up_score, {r('top_score - runner_up_score')} AS runner_up_margin,
  CASE WHEN actionable_count = 0 OR unresolved_count > 0 OR conflict_count IS NOT NULL THEN 'ASK_CLARIFICATION'
    WHEN top_score IS NULL OR top_score < 0.15 OR top_coverage < 0.5 THEN 'ABSTAIN'
    WHEN top_score - runner_up_score <= 0.05 THEN 'COMPARE' ELSE 'RECOMMEND' END AS action,
  CASE WHEN actionable_count = 0 OR unresolved_count > 0 OR conflict_count IS NOT NULL THEN concat_ws(',',
      CASE WHEN actionable_count = 0 THEN 'NO_RESOLVED_ACTIONABLE_REQUIREMENT' END,
      CASE WHEN unresolved_count > 0 THEN 'UNRESOLVED_ACTIONABLE_REQUIREMENT' END,
      CASE WHEN conflict_count IS NOT NULL THEN 'CONFLICTING_REQUIREMENTS' END)
    WHEN top_score IS NULL THEN 'NO_CANDIDATE'
    WHEN top_score < 0.15 OR top_coverage < 0.5 THEN concat_ws(',', CASE WHEN top_score < 0.15 THEN 'TOP_SCORE_BELOW_THRESHOLD' END,
      CASE WHEN top_coverage < 0.5 THEN 'REQUIREMENT_COVERAGE_BELOW_THRESHOLD' END)
    ELSE 'TOP_SCORE_ABOVE_THRESHOLD,REQUIREMENT_COVERAGE_SUFFICIENT,' || CASE
      WHEN top_score - runner_up_score <= 0.05 THEN 'TOP_CANDIDATES_WITHIN_COMPARE_MARGIN'
      WHEN runner_up_score IS NULL THEN 'NO_RUNNER_UP_AVAILABLE' ELSE 'RUNNER_UP_MARGIN_EXCEEDS_COMPARE_THRESHOLD' END END AS reason_codes
FROM (SELECT request_id, source_id, count(*) FILTER (WHERE reasons = '' AND sentiment IN ('positive', 'negative')) AS actionable_count,
    count(*) FILTER (WHERE reasons <> '' AND sentiment IN ('positive', 'negative')) AS unresolved_count FROM resolved GROUP BY 1, 2)
LEFT JOIN (SELECT request_id, max(candidate_name) FILTER (WHERE rank = 1) AS top_product_name, max(score) FILTER (WHERE rank = 1) AS top_score,
    max(evidence_coverage) FILTER (WHERE rank = 1) AS top_coverage, max(candidate_name) FILTER (WHERE rank = 2) AS runner_up_product_name,
    max(score) FILTER (WHERE rank = 2) AS runner_up_score FROM dranked GROUP BY 1) USING (request_id)
LEFT JOIN (SELECT request_id, count(*) AS conflict_count FROM clashes GROUP BY 1) USING (request_id)""",
    True,
    DECISION,
)

# --- normalization ----------------------------------------------------------------------------


def cosine(a: str, b: str) -> str:
    inner = f"list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b}))"
    return f"greatest(0.0::DOUBLE, least(2.0::DOUBLE, 1 - {inner}))"


def mean_vector(source: str, keys: str, name: str) -> str:
    return f"""{name} AS (SELECT {keys}, list(x ORDER BY i) AS centroid FROM (
    SELECT {keys}, i, avg(x) AS x FROM (SELECT {keys}, unnest(range(64)) AS i, unnest(embedding) AS x FROM {source})
    GROUP BY ALL) GROUP BY ALL)"""


EXPRESSIONS = """
WITH seen AS (SELECT user_id AS vec_id, count(*) AS n FROM events GROUP BY 1),
expressions AS (SELECT vec_id, printf('e%06d', vec_id) AS text, label AS boundary,
    coalesce(n, 1) AS unique_review_count, embedding::DOUBLE[] AS embedding FROM embeddings LEFT JOIN seen USING (vec_id)),
clustered AS (SELECT *, 'C-' || boundary || '-' || (embedding[1] > 0)::INTEGER || '-' || (embedding[2] > 0)::INTEGER AS cluster_id
  FROM expressions)"""


def ranking(expressions: str, members: str) -> str:
    """CTEs ending in ``best``: nearest and second cluster of expression_id inside its boundary."""
    return f"""
, farthest AS (SELECT e.expression_id, e.boundary, m.cluster_id, max({cosine('e.embedding', 'm.embedding')}) AS mx,
    any_value(e.embedding) AS embedding FROM {expressions} e JOIN {members} m USING (boundary) GROUP BY 1, 2, 3),
heads AS (SELECT boundary, cluster_id, min(label) AS label, arg_min(embedding, text) AS canonical FROM {members} GROUP BY 1, 2),
{mean_vector(members, 'boundary, cluster_id', 'centres')},
measured AS (SELECT f.*, h.label, {cosine('f.embedding', 'c.centroid')} AS cd, {cosine('f.embedding', 'h.canonical')} AS pd
  FROM farthest f JOIN heads h USING (boundary, cluster_id) JOIN centres c USING (boundary, cluster_id)),
placed AS (SELECT *, mx <= 1.2 + 1e-6 AS eligible, row_number() OVER w AS n, lead(mx) OVER w AS next_mx FROM measured
  WINDOW w AS (PARTITION BY expression_id, boundary ORDER BY mx <= 1.2 + 1e-6 DESC, mx, cd, pd, cluster_id)),
best AS (SELECT expression_id, boundary, cluster_id AS suggested_id, label AS suggested_label, {r('pd', 8)} AS distance,
    {r('mx', 8)} AS membership_max_distance, {r('cd', 8)} AS centroid_distance, {r('next_mx', 8)} AS second_nearest_distance,
    {r('next_mx - mx', 8)} AS distance_margin, eligible AS candidate_eligible FROM placed WHERE n = 1)"""


ORACLES["candidate_ranking"] = (
    EXPRESSIONS
    + ", asked AS (SELECT *, vec_id AS expression_id FROM expressions), members AS (SELECT *, text AS label FROM clustered)"
    + ranking("asked", "members")
    + " SELECT * FROM best"
)
ORACLES["candidate_ranking_global"] = (
    EXPRESSIONS
    + """, asked AS (SELECT vec_id AS expression_id, 'all' AS boundary, embedding FROM expressions),
members AS (SELECT 'all' AS boundary, 'L-' || boundary AS cluster_id, text, text AS label, embedding FROM expressions)"""
    + ranking("asked", "members")
    + " SELECT * FROM best"
)
TEXTS = """
, texts AS (SELECT t.text, e.embedding::DOUBLE[] AS embedding FROM (SELECT text, (row_number() OVER (ORDER BY text) - 1) % (SELECT max(vec_id) + 1 FROM embeddings) AS vec_id
  FROM (SELECT raw_aspect AS text FROM units UNION SELECT raw_status FROM units WHERE raw_status IS NOT NULL)) t
  JOIN embeddings e USING (vec_id)),
seen AS (SELECT raw_aspect, raw_status, aspect_id, aspect, status_id, status, count(*) AS n FROM units
  WHERE source_opinion_unit_idx IS NOT NULL AND aspect <> 'anvil' GROUP BY ALL),
often AS (SELECT raw_aspect, sum(n) AS n FROM seen GROUP BY 1),
known AS (SELECT * FROM seen WHERE raw_aspect IN (SELECT raw_aspect FROM often WHERE n >= (SELECT avg(n) FROM often))),
known_statuses AS (SELECT aspect_id, raw_status, status_id, status, sum(n) AS n FROM known WHERE raw_status IS NOT NULL
  GROUP BY ALL),
amembers AS (SELECT 'all' AS boundary, k.aspect_id AS cluster_id, k.aspect AS label, t.text, t.embedding
  FROM (SELECT DISTINCT raw_aspect, aspect_id, aspect FROM known) k JOIN texts t ON t.text = k.raw_aspect),
smembers AS (SELECT k.aspect_id AS boundary, k.status_id AS cluster_id, k.status AS label, t.text, t.embedding
  FROM (SELECT * FROM known_statuses WHERE n >= (SELECT avg(n) FROM known_statuses)) k
  JOIN texts t ON t.text = k.raw_status)"""
MAPS = f"""
, amap AS (SELECT m.text AS raw_aspect, m.cluster_id AS aspect_id, m.label AS aspect, {cosine('m.embedding', 'h.canonical')} AS aspect_map_distance
  FROM amembers m JOIN (SELECT cluster_id, arg_min(embedding, text) AS canonical FROM amembers GROUP BY 1) h USING (cluster_id)),
smap AS (SELECT m.boundary AS aspect_id, m.text AS raw_status, m.cluster_id AS status_id, m.label AS status,
    {cosine('m.embedding', 'h.canonical')} AS status_map_distance
  FROM smembers m JOIN (SELECT boundary, cluster_id, arg_min(embedding, text) AS canonical FROM smembers GROUP BY 1, 2) h
    USING (boundary, cluster_id))"""
ORACLES["exact_mapping"] = base(
    f"""SELECT u.opinion_unit_id, u.raw_aspect, u.raw_status, a.aspect_id, a.aspect, s.status_id, s.status,
  {r('a.aspect_map_distance', 8)} AS aspect_map_distance, {r('s.status_map_distance', 8)} AS status_map_distance
FROM units u LEFT JOIN amap a ON a.raw_aspect = u.raw_aspect
LEFT JOIN smap s ON s.aspect_id = a.aspect_id AND s.raw_status = u.raw_status""",
    False,
    TEXTS + MAPS,
)


def _renamed(text: str, prefix: str) -> str:
    names = "farthest|heads|centres|measured|placed|best"
    text = re.sub(rf"\b({names}) AS \(SELECT", rf"{prefix}\1 AS (SELECT", text)
    return re.sub(rf"\b(FROM|JOIN) ({names})\b", rf"\1 {prefix}\2", text)


_DIAGNOSTICS = (
    "membership_max_distance centroid_distance second_nearest_distance distance_margin candidate_eligible"
).split()


def _suggested(part: str, alias: str) -> str:
    return ", ".join(f"{alias}.{name} AS {part}_{name}" for name in _DIAGNOSTICS)


ORACLES["mapping_state_machine"] = base(
    f"""SELECT u.opinion_unit_id, u.raw_aspect, u.raw_status,
  CASE WHEN u.kept_out THEN 'excluded_taxonomy' WHEN u.aspect_id IS NOT NULL AND (u.raw_status IS NULL OR u.status_id IS NOT NULL)
    THEN 'mapped_exact' ELSE 'candidate' END AS mapping_state,
  u.aspect_id, u.aspect, u.status_id, u.status,
  u.suggested_aspect_id, u.suggested_aspect, coalesce({r('u.aspect_map_distance', 8)}, u.aspect_candidate) AS aspect_distance,
  {', '.join('u.aspect_' + n for n in _DIAGNOSTICS)},
  s.suggested_id AS suggested_status_id, s.suggested_label AS suggested_status,
  coalesce({r('u.status_map_distance', 8)}, s.distance) AS status_distance, {_suggested('status', 's')}
FROM searched u LEFT JOIN sbest s ON s.boundary = u.search_id AND s.expression_id = u.raw_status AND u.status_id IS NULL""",
    False,
    TEXTS
    + MAPS
    + """
, looked AS (SELECT u.opinion_unit_id, u.raw_aspect, u.raw_status, u.aspect = 'anvil' AS kept_out, a.aspect_id, a.aspect,
    a.aspect_map_distance, s.status_id, s.status, s.status_map_distance
  FROM units u LEFT JOIN amap a ON a.raw_aspect = u.raw_aspect AND u.aspect <> 'anvil'
  LEFT JOIN smap s ON s.aspect_id = a.aspect_id AND s.raw_status = u.raw_status),
aasked AS (SELECT 'all' AS boundary, t.text AS expression_id, t.embedding FROM texts t
  WHERE t.text IN (SELECT raw_aspect FROM looked WHERE NOT kept_out AND aspect_id IS NULL))"""
    + _renamed(ranking("aasked", "amembers"), "a")
    + f"""
, searched AS (SELECT l.*, coalesce(l.aspect_id, b.suggested_id) AS search_id, b.suggested_id AS suggested_aspect_id,
    b.suggested_label AS suggested_aspect, b.distance AS aspect_candidate, {_suggested('aspect', 'b')}
  FROM looked l LEFT JOIN abest b ON b.expression_id = l.raw_aspect AND NOT l.kept_out AND l.aspect_id IS NULL),
sasked AS (SELECT q.search_id AS boundary, t.text AS expression_id, t.embedding
  FROM (SELECT DISTINCT search_id, raw_status FROM searched WHERE raw_status IS NOT NULL AND status_id IS NULL AND search_id IS NOT NULL) q
  JOIN texts t ON t.text = q.raw_status)"""
    + _renamed(ranking("sasked", "smembers"), "s"),
)

# --- taxonomy ---------------------------------------------------------------------------------
DETAILS = f"""
, pairwise AS (SELECT a.cluster_id, a.text, max(a.unique_review_count) AS unique_review_count, count(*) AS member_count,
    coalesce(sum(CASE WHEN a.text <> b.text THEN {cosine('a.embedding', 'b.embedding')} END) / nullif(count(*) - 1, 0), 0) AS average_distance,
    coalesce(max(CASE WHEN a.text <> b.text THEN {cosine('a.embedding', 'b.embedding')} END), 0) AS max_distance
  FROM clustered a JOIN clustered b USING (cluster_id) GROUP BY 1, 2),
central AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY average_distance, text)
      <= CASE WHEN member_count = 1 THEN 1 WHEN member_count = 2 THEN 2 WHEN member_count < 10 THEN 3 ELSE 5 END AS central_candidate,
    text NOT IN ('e000003', 'e000010', 'e000017') AS role_filter_passed FROM pairwise),
eligible AS (SELECT *, central_candidate AND (role_filter_passed OR member_count = 1) AS ok FROM central),
scored AS (SELECT *, CASE WHEN ok THEN CASE WHEN member_count = 1 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - average_distance / 2)) END END AS centrality,
    CASE WHEN ok THEN CASE WHEN member_count = 1 THEN 1.0::DOUBLE
      ELSE ln(1 + unique_review_count) / max(CASE WHEN ok THEN ln(1 + unique_review_count) END) OVER (PARTITION BY cluster_id) END END AS frequency_score
  FROM eligible),
details AS (SELECT *, CASE WHEN ok THEN CASE WHEN member_count = 1 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE * centrality + 0.3::DOUBLE * frequency_score END END AS combined_score FROM scored),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY combined_score DESC, average_distance,
    unique_review_count DESC, text) AS n FROM details WHERE ok) WHERE n = 1),
labels AS (SELECT c.*, CASE WHEN member_count = 1 THEN 'singleton_inherited' WHEN mx > 1.25 + 1e-12 THEN 'cohesion_review_required'
      WHEN f.text IS NULL THEN 'no_role_eligible_candidate' ELSE 'selected' END AS naming_status, f.text AS first_text,
    f.average_distance AS first_average, f.max_distance AS first_max
  FROM (SELECT cluster_id, any_value(member_count) AS member_count, max(max_distance) AS mx,
          arg_min(text, (average_distance, text)) AS medoid_label FROM details GROUP BY 1) c
  LEFT JOIN (SELECT cluster_id, text, average_distance, max_distance FROM firsts) f USING (cluster_id)),
named AS (SELECT *, CASE WHEN naming_status IN ('singleton_inherited', 'selected') THEN first_text END AS canonical_label FROM labels)"""
ORACLES["cluster_labels"] = (
    EXPRESSIONS
    + DETAILS
    + f""" SELECT cluster_id, member_count, {r('mx', 8)} AS cluster_max_distance, medoid_label, canonical_label, naming_status,
  CASE WHEN canonical_label IS NOT NULL THEN {r('first_average', 8)} END AS representative_average_distance,
  CASE WHEN canonical_label IS NOT NULL THEN {r('first_max', 8)} END AS representative_max_distance FROM named"""
)
ORACLES["cluster_member_details"] = (
    EXPRESSIONS
    + DETAILS
    + f""" SELECT cluster_id, text, unique_review_count, central_candidate, role_filter_passed, {r('average_distance', 8)} AS average_distance,
  {r('max_distance', 8)} AS max_distance, {r('centrality', 8)} AS centrality, {r('frequency_score', 8)} AS frequency_score,
  {r('combined_score', 8)} AS combined_score FROM details"""
)
ORACLES["cluster_stats"] = (
    EXPRESSIONS
    + DETAILS
    + f""", {mean_vector('clustered', 'cluster_id', 'centres')}
SELECT n.cluster_id, n.member_count, m.source_row_count, n.canonical_label, m.member_expressions,
  CASE WHEN n.canonical_label IS NOT NULL THEN {r(cosine('e.embedding', 'c.centroid'), 8)} END AS representative_centroid_distance
FROM named n JOIN centres c USING (cluster_id)
JOIN (SELECT cluster_id, sum(unique_review_count)::BIGINT AS source_row_count, string_agg(text, ',' ORDER BY text) AS member_expressions
  FROM clustered GROUP BY 1) m USING (cluster_id) LEFT JOIN expressions e ON e.text = n.canonical_label"""
)
ORACLES["node_mapping_distance"] = (
    EXPRESSIONS
    + DETAILS
    + f""" SELECT m.cluster_id, m.text, n.canonical_label, coalesce(m.text <> n.canonical_label, false) AS mapping_applied,
  coalesce(CASE WHEN m.text <> n.canonical_label THEN {r(cosine('m.embedding', 'e.embedding'), 8)} END, 0.0::DOUBLE) AS mapping_distance
FROM clustered m JOIN named n USING (cluster_id) LEFT JOIN expressions e ON e.text = n.canonical_label"""
)
ORACLES["mapping_nodes"] = base(
    """SELECT aspect_id AS boundary, raw_status AS text, count(*) AS source_row_count, count(DISTINCT review_id) AS unique_review_count
FROM units WHERE raw_status IS NOT NULL GROUP BY 1, 2""",
    False,
)
ORACLES["remap_with_late_rows"] = base(
    """SELECT opinion_unit_id,
  CASE WHEN NOT captured THEN mapping_state WHEN kept_out THEN 'excluded_taxonomy' ELSE 'mapped_exact' END AS mapping_state,
  CASE WHEN NOT captured THEN aspect_id WHEN NOT kept_out THEN 'v2-' || aspect_id END AS aspect_id,
  CASE WHEN NOT captured THEN aspect WHEN NOT kept_out THEN upper(aspect) END AS aspect,
  CASE WHEN NOT captured THEN status_id WHEN NOT kept_out THEN 'v2-' || status_id END AS status_id,
  CASE WHEN NOT captured THEN status WHEN NOT kept_out THEN lower(status) END AS status,
  aspect_distance, status_distance, CASE WHEN captured THEN 'v2' ELSE 'v1' END AS mapping_table_version_id
FROM (SELECT *, source_opinion_unit_idx IS NOT NULL AS captured, mapping_state = 'excluded_taxonomy' AS kept_out FROM units)""",
    False,
)
ORACLES["rebuild_audit"] = base(
    """SELECT count(*) FILTER (WHERE source_opinion_unit_idx IS NOT NULL) AS captured_opinion_unit_count,
  count(*) FILTER (WHERE source_opinion_unit_idx IS NULL) AS carried_forward_opinion_unit_count,
  0::BIGINT AS missing_opinion_unit_count FROM units""",
    False,
)

# --- ingestion --------------------------------------------------------------------------------
_WHITE = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{_WHITE}+|{_WHITE}+$', '', 'g')"


STAGED = f"""
WITH staged AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS source_review_id,
    'review-' || substr(sha256('catalog_inbox|' || doc_id), 1, 16) AS review_id, 'catalog_inbox' AS source,
    source AS product_id, upper(source) AS product_name, lang AS category, sha256({strip('text')}) AS content_sha256 FROM documents),
existing AS (SELECT DISTINCT s.content_sha256 FROM staged s JOIN labels l USING (doc_id) WHERE l.quality = 1),
kept AS (SELECT * FROM staged WHERE content_sha256 NOT IN (SELECT content_sha256 FROM existing)
  QUALIFY row_number() OVER (PARTITION BY content_sha256 ORDER BY doc_id) = 1)"""
ORACLES["surrogate_ids"] = (
    STAGED
    + " SELECT source_review_id, review_id, source, content_sha256, "
    + "'monitor-' || substr(sha256(product_name), 1, 16) AS product_key FROM staged"
)
ORACLES["dedup_inbox"] = STAGED + " SELECT source_review_id, product_id, content_sha256 FROM kept"
ORACLES["dedup_duplicate_count"] = (
    STAGED
    + " SELECT (SELECT count(*) FROM staged) - (SELECT count(*) FROM kept) AS duplicate_count"
)
ORACLES["insert_or_ignore_products"] = """
WITH keyed AS (SELECT source || '/' || lang AS product_id, doc_id, upper(source) AS product_name, lang AS category FROM documents),
firsts AS (SELECT k.*, l.doc_id IS NOT NULL AS known FROM keyed k LEFT JOIN labels l USING (doc_id)),
known AS (SELECT DISTINCT ON (product_id) product_id, product_name, category, 'seed' AS first_seen_run_id
  FROM firsts WHERE known ORDER BY product_id, doc_id)
SELECT * FROM known UNION ALL
SELECT DISTINCT ON (product_id) product_id, product_name, category, 'run-1' AS first_seen_run_id
FROM firsts WHERE product_id NOT IN (SELECT product_id FROM known) ORDER BY product_id"""
DOCUMENT_UNITS = """
WITH lines AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
    unnest(range(1, len(string_split(text, chr(10))) + 1))::INTEGER AS unit_position FROM documents),
dunits AS (SELECT doc_id, text AS review_text, unit_position, string_split(line, ' ')[1] AS raw_aspect,
    string_split(line, ' ')[2] AS raw_status, CASE WHEN length(line) % 7 = 0 THEN line || '#' ELSE line END AS excerpt,
    line AS opinion, ['positive', 'negative', 'mixed', 'neutral', 'unknown', 'joyful'][length(line) % 6 + 1] AS sentiment FROM lines)"""
_SPACE_ONLY = f"regexp_full_match(%s, '{_WHITE}*')"
CHECKED = (
    DOCUMENT_UNITS
    + f""",
checked AS (SELECT *, concat_ws(',', CASE WHEN {_SPACE_ONLY % 'raw_aspect'} THEN 'BLANK_ASPECT' END,
    CASE WHEN {_SPACE_ONLY % 'raw_status'} THEN 'BLANK_STATUS' END, CASE WHEN {_SPACE_ONLY % 'excerpt'} THEN 'BLANK_EXCERPT' END,
    CASE WHEN NOT {_SPACE_ONLY % 'excerpt'} AND NOT contains(review_text, excerpt) THEN 'UNGROUNDED_EXCERPT' END,
    CASE WHEN {_SPACE_ONLY % 'opinion'} THEN 'BLANK_OPINION' END,
    CASE WHEN sentiment = 'joyful' THEN 'INVALID_SENTIMENT' END) AS violations FROM dunits)"""
)
ORACLES["field_validation"] = CHECKED + " SELECT doc_id, unit_position, violations FROM checked"
ORACLES["grounding_check"] = (
    CHECKED
    + " SELECT doc_id, unit_position, excerpt FROM checked "
    + f"WHERE {_SPACE_ONLY % 'excerpt'} OR NOT contains(review_text, excerpt)"
)
ORACLES["valid_units_dropped"] = (
    CHECKED
    + f" SELECT doc_id, unit_position, {strip('raw_aspect')} AS raw_aspect, {strip('raw_status')} AS raw_status, "
    + f"{strip('opinion')} AS opinion, sentiment FROM checked WHERE violations = ''"
)
ORACLES["json_units_explode"] = (
    DOCUMENT_UNITS
    + " SELECT doc_id, unit_position, raw_aspect, raw_status, excerpt, opinion, sentiment FROM dunits"
)
ORACLES["json_field_contract"] = """
SELECT event_id, array_to_string(list_filter(['k', 'v'], lambda x: NOT list_contains(json_keys(props), x)), ',') AS missing,
  array_to_string(list_filter(json_keys(props), lambda x: NOT list_contains(['k', 'v'], x)), ',') AS unexpected FROM events"""
ORACLES["non_product_filter"] = base(
    """SELECT opinion_unit_id, raw_aspect,
  contains(replace(raw_aspect, ' ', ''), 'dring') OR contains(replace(raw_aspect, ' ', ''), 'anvil') AS is_non_product FROM units""",
    False,
)
ORACLES["submission_validation"] = base(
    """SELECT product_id AS submission_id, count(*) AS review_count, count(*) FILTER (WHERE trim(review_text) = '') AS blank_count,
  count(*) FILTER (WHERE length(review_text) > 10000) AS overlong_count FROM reviews GROUP BY 1 HAVING count(*) > 20""",
    False,
    by_customer=True,
)
ORACLES["commit_receipt"] = base(
    """SELECT 'run-1' AS run_id, (SELECT count(*) FROM reviews) AS review_count, count(*) AS opinion_unit_count,
  count(*) FILTER (WHERE mapping_state = 'candidate') AS candidate_count FROM units""",
    False,
)
ORACLES["rebuild_recommendation"] = base(
    """SELECT strftime(created_at, '%Y-%m') AS run_id, count(*) AS opinion_unit_count,
  count(*) FILTER (WHERE mapping_state = 'candidate') AS candidate_count,
  count(*) FILTER (WHERE mapping_state = 'candidate') >= 100 AS recommended FROM catalog GROUP BY 1""",
    False,
)
ORACLES["mapping_differences"] = base(
    """SELECT opinion_unit_id, aspect AS left_aspect, status AS left_status,
  CASE WHEN mapping_state <> 'excluded_taxonomy' THEN upper(aspect) END AS right_aspect,
  CASE WHEN mapping_state <> 'excluded_taxonomy' THEN lower(status) END AS right_status
FROM units WHERE source_opinion_unit_idx IS NOT NULL""",
    False,
)
_CHECKS = {
    "unit_key_unique": "SELECT opinion_unit_id FROM units GROUP BY 1 HAVING count(*) > 1",
    "unit_key_not_null": "SELECT 1 FROM units WHERE opinion_unit_id IS NULL OR review_id IS NULL",
    "review_key_unique": "SELECT review_id FROM reviews GROUP BY 1 HAVING count(*) > 1",
    "line_key_unique": "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    "one_label_per_aspect": "SELECT aspect_id FROM units GROUP BY 1 HAVING count(DISTINCT aspect) > 1",
    "one_aspect_per_status": "SELECT status_id FROM units WHERE status_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT (aspect_id, status)) > 1",
    "units_have_review": "SELECT 1 FROM units WHERE review_id NOT IN (SELECT review_id FROM reviews)",
    "reviews_have_product": "SELECT 1 FROM reviews WHERE product_id NOT IN (SELECT product_id FROM products)",
    "reviews_have_units": "SELECT 1 FROM reviews WHERE review_id NOT IN (SELECT review_id FROM units)",
    "excerpts_grounded": "SELECT 1 FROM catalog WHERE NOT contains(review_text, excerpt)",
    "constant_lineage": "SELECT DISTINCT 'v2' AS version FROM units WHERE source_opinion_unit_idx IS NOT NULL OFFSET 1",
    "mixed_lineage": "SELECT DISTINCT CASE WHEN source_opinion_unit_idx IS NULL THEN 'v1' ELSE 'v2' END AS version FROM units OFFSET 1",
    "embeddings_valid": "SELECT 1 FROM embeddings WHERE len(embedding) <> 64",
    "source_rows_preserved": "SELECT review_id FROM reviews EXCEPT SELECT review_id FROM units",
    "distribution_invariants": "SELECT 1 WHERE false",
}
ORACLES["integrity_checks"] = base(
    "SELECT *, violations = 0 AS passed FROM ("
    + " UNION ALL ".join(
        f"SELECT '{name}' AS check, count(*) AS violations FROM ({sql})" for name, sql in _CHECKS.items()
    ).replace(" AS check,", ' AS "check",')
    + ")",
    False,
)

# --- evaluation -------------------------------------------------------------------------------
RATINGS = """
WITH ratings AS (SELECT l_suppkey AS item_id, l_linenumber AS rater_id, substr('ABCD', l_linenumber % 4 + 1, 1) AS arm,
    round(l_discount * 100)::INTEGER % 5 + 1 AS score, l_returnflag = 'R' AS preferred FROM lineitem),
item_means AS (SELECT item_id, arm, avg(score) AS score FROM ratings GROUP BY 1, 2)"""
ORACLES["rating_summary"] = (
    RATINGS
    + f" SELECT arm, count(*) AS item_count, {r('avg(score)')} AS mean_score, {r('stddev_samp(score)')} AS sd_score FROM item_means GROUP BY 1"
)
ORACLES["factorial_effects"] = (
    RATINGS
    + f""", wide AS (SELECT item_id, max(score) FILTER (WHERE arm = 'A') AS a, max(score) FILTER (WHERE arm = 'B') AS b,
  max(score) FILTER (WHERE arm = 'C') AS c, max(score) FILTER (WHERE arm = 'D') AS d FROM item_means GROUP BY 1 HAVING count(*) = 4)
SELECT count(*) AS item_count, {r('avg(((c + d) - (a + b)) / 2)')} AS structured_effect,
  {r('avg(((b + d) - (a + c)) / 2)')} AS clustering_effect, {r('avg((d - c) - (b - a))')} AS interaction_effect FROM wide"""
)
ORACLES["preference_rates"] = (
    RATINGS
    + f""" SELECT arm, count(*) AS preference_count, {r('count(*)::DOUBLE / sum(count(*)) OVER ()')} AS preference_rate
FROM ratings WHERE preferred GROUP BY 1"""
)
ORACLES["cohort_violations"] = (
    RATINGS
    + """ SELECT rater_id, item_id, count(*) AS row_count, bit_or(1 << (ascii(arm) - 65)) AS arms,
  count(*) FILTER (WHERE preferred) AS preferences, count(*) FILTER (WHERE score NOT BETWEEN 1 AND 5) AS invalid_scores
FROM ratings GROUP BY 1, 2
HAVING count(*) <> 4 OR count(DISTINCT arm) <> 4 OR count(*) FILTER (WHERE preferred) <> 1"""
)
ORACLES["icc"] = (
    RATINGS
    + f""", cells AS (SELECT item_id, rater_id, avg(score) AS x FROM ratings GROUP BY 1, 2),
full_cells AS (SELECT * FROM cells WHERE item_id IN (SELECT item_id FROM cells GROUP BY 1
  HAVING count(*) = (SELECT count(DISTINCT rater_id) FROM cells))),
marked AS (SELECT *, avg(x) OVER (PARTITION BY item_id) AS im, avg(x) OVER (PARTITION BY rater_id) AS rm, avg(x) OVER () AS gm FROM full_cells),
sizes AS (SELECT count(DISTINCT item_id) AS n, count(DISTINCT rater_id) AS k FROM full_cells),
squares AS (SELECT sum((im - gm) * (im - gm)) AS ssr, sum((rm - gm) * (rm - gm)) AS ssc,
  sum((x - im - rm + gm) * (x - im - rm + gm)) AS sse FROM marked),
ms AS (SELECT n, k, ssr / (n - 1) AS msr, ssc / (k - 1) AS msc, sse / ((n - 1) * (k - 1)) AS mse FROM squares, sizes)
SELECT n AS item_count, k AS rater_count, {r('(msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n)')} AS icc_2_1 FROM ms"""
)
ORACLES["cluster_silhouettes"] = (
    EXPRESSIONS
    + f""", sums AS (SELECT a.boundary, a.cluster_id, a.text, b.cluster_id AS other_id, count(*) AS n,
    sum(CASE WHEN a.text <> b.text THEN {cosine('a.embedding', 'b.embedding')} ELSE 0 END) AS total
  FROM clustered a JOIN clustered b USING (boundary) GROUP BY 1, 2, 3, 4),
nodes AS (SELECT boundary, cluster_id, text, max(CASE WHEN cluster_id = other_id AND n > 1 THEN total / (n - 1) END) AS a,
    min(CASE WHEN cluster_id <> other_id THEN total / n END) AS b FROM sums GROUP BY 1, 2, 3)
SELECT CAST(boundary AS VARCHAR) AS boundary, cluster_id, count(*) AS member_count,
  {r('avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END)')} AS cluster_silhouette_mean FROM nodes GROUP BY 1, 2"""
)
ORACLES["nearest_cluster_pairs"] = (
    EXPRESSIONS
    + f""", {mean_vector('clustered', 'cluster_id', 'centres')}
SELECT a.cluster_id AS lo, b.cluster_id AS hi, {r(cosine('a.centroid', 'b.centroid'), 8)} AS distance
FROM centres a JOIN centres b ON a.cluster_id < b.cluster_id ORDER BY distance, lo, hi LIMIT 50"""
)

ORACLES["sentiment_summary"] = base(
    f"""SELECT m.*, {', '.join(f"coalesce({r(f'{s}_count::DOUBLE / supporting_review_count')}, 0.0::DOUBLE) AS {s}_share" for s in SENTIMENTS)},
  {r(wilson('positive_count', 'supporting_review_count', 'lower'))} AS positive_wilson_lower,
  {r(wilson('positive_count', 'supporting_review_count', 'upper'))} AS positive_wilson_upper
FROM (SELECT product_id, aspect_id, aspect, count(*) AS supporting_review_count, {COUNTS} FROM av GROUP BY 1, 2, 3) m"""
)
ORACLES["excluded_experience"] = base(
    """SELECT product_id, count(*) AS excluded_opinion_unit_count, count(DISTINCT review_id) AS excluded_review_count
FROM catalog WHERE mapping_state = 'excluded_taxonomy' GROUP BY 1""",
    False,
)
ORACLES["risky_clusters_present"] = base(
    """SELECT product_id, count(DISTINCT status_id) AS risky_cluster_count FROM pv
WHERE status_id IN (SELECT status_id FROM risks WHERE risk > (SELECT avg(risk) FROM risks) + 1e-12) GROUP BY 1""",
    True,
    """, risks AS (SELECT status_id, count(*) FILTER (WHERE vote = 'unknown')::DOUBLE / count(*) AS risk
  FROM pv WHERE status_id IS NOT NULL GROUP BY 1)""",
)
ORACLES["catalog_submissions"] = base(
    """SELECT 'demo-review-' || review_id AS submission_id, product_id, review_text, count(*)::INTEGER AS unit_count,
  string_agg(raw_aspect, ',' ORDER BY unit_position) AS raw_aspects, string_agg(sentiment, ',' ORDER BY unit_position) AS sentiments
FROM fact GROUP BY review_id, product_id, review_text""",
    False,
)
ORACLES["submission_results"] = base(
    """SELECT 'demo-' || review_id AS demo_review_id, unit_position, raw_aspect, raw_status, aspect, status, sentiment,
  mapping_state, excerpt, opinion FROM catalog""",
    False,
)
ORACLES["submission_unit_problems"] = base(
    """SELECT request_id AS submission_id, unit_position, resolved_aspect_id, resolved_status_id, true AS catalog_comparison_eligible,
  concat_ws(',', CASE WHEN sentiment = 'mixed' THEN 'UNGROUNDED_EXCERPT' END, nullif(reasons, '')) AS problems FROM resolved""",
    False,
    """
, requested AS (SELECT review_id AS request_id, unit_position, CASE WHEN mapping_state = 'mapped_exact' THEN aspect ELSE raw_aspect END AS aspect,
    coalesce(status, raw_status) AS status, sentiment, NULL::VARCHAR AS aspect_cluster_id, NULL::VARCHAR AS status_cluster_id FROM catalog)"""
    + RESOLVE,
)
# Two status types never reach the matching ratio, so cores oppose exactly where they are equal.
ORACLES["cannot_link_pairs"] = base(
    """SELECT a.aspect_id AS boundary, a.raw_status AS lo, b.raw_status AS hi
FROM (SELECT DISTINCT aspect_id, raw_status FROM units WHERE raw_status IS NOT NULL) a
JOIN (SELECT DISTINCT aspect_id, raw_status FROM units WHERE raw_status IS NOT NULL) b
  ON a.aspect_id = b.aspect_id AND a.raw_status < b.raw_status
WHERE (split_part(a.raw_status, '/', 1) = split_part(b.raw_status, '/', 1) AND split_part(a.raw_status, '/', 2) <> split_part(b.raw_status, '/', 2))
   OR (a.raw_status = 'ECONOMY/F' AND b.raw_status = 'LARGE/O')""",
    False,
)
_KEPT_OUT = ", ".join(f"'{colour} anvil'" for colour in "blue cold hot large new old red small".split())
ORACLES["taxonomy_invariants"] = base(
    f"""SELECT 'units' AS name, count(*) AS value FROM units
UNION ALL SELECT 'aspect_nodes', count(DISTINCT raw_aspect) FROM eligible
UNION ALL SELECT 'aspect_source_rows', count(*) FROM eligible
UNION ALL SELECT 'status_source_rows', count(raw_status) FROM eligible
UNION ALL SELECT unnest(['wide_clusters', 'mergeable_aspect_clusters', 'mergeable_status_clusters', 'opposed_members',
  'miscounted_reviews']), 0""",
    False,
    f", eligible AS (SELECT * FROM units WHERE raw_aspect NOT IN ({_KEPT_OUT}))",
)
ORACLES["bundle_import"] = base(
    """SELECT 'legacy-ou-' || (review_id * 100 + unit_position) AS opinion_unit_id, review_id * 100 + unit_position AS source_opinion_unit_idx,
  'legacy-review-' || review_id AS review_id, unit_position, raw_aspect, raw_status, sentiment,
  CASE WHEN mapping_state = 'mapped_exact' THEN 'mapped_exact' ELSE 'excluded_taxonomy' END AS mapping_state,
  CASE WHEN mapping_state = 'mapped_exact' THEN aspect_id END AS aspect_id, CASE WHEN mapping_state = 'mapped_exact' THEN status_id END AS status_id,
  CASE WHEN mapping_state = 'mapped_exact' THEN aspect_distance END::DOUBLE AS aspect_distance,
  CASE WHEN mapping_state = 'mapped_exact' THEN status_distance END::DOUBLE AS status_distance,
  'mapping-1' AS mapping_table_version_id, sha256('response ' || review_text) AS extraction_response_sha256 FROM catalog"""
)
ORACLES["bundle_import_reviews"] = base(
    """SELECT 'legacy-review-' || review_id AS review_id, review_id::VARCHAR AS source_review_id, review_id AS external_review_idx,
  'monitor-' || substr(sha256(product_name), 1, 16) AS product_id, product_name, '모니터' AS category,
  sha256(trim(review_text)) AS content_sha256, (SELECT count(*) FROM units u WHERE u.review_id = v.review_id AND u.unit_position = 1) AS attribute_count
FROM reviews v JOIN products p USING (product_id)""",
    False,
)
ORACLES["report_inputs"] = base(
    """SELECT product_name, CASE WHEN mapping_state = 'mapped_exact' THEN 'mapped_exact' ELSE 'excluded_taxonomy' END AS mapping_state,
  count(*) AS opinion_unit_count, count(DISTINCT review_id) AS review_count FROM catalog JOIN products USING (product_id) GROUP BY 1, 2""",
    False,
)
ORACLES["encoded_texts"] = base(
    """SELECT text, 'characters-16' AS encoder_version, string_agg(format('{:.4f}', (n / sqrt(total))::FLOAT::DOUBLE), ',' ORDER BY place) AS entries
FROM (SELECT text, place, count(code) AS n, sum(count(code) * count(code)) OVER (PARTITION BY text) AS total
  FROM texts CROSS JOIN range(16) r(place) LEFT JOIN codes USING (text, place) GROUP BY text, place) GROUP BY text""",
    False,
    """, texts AS (SELECT raw_aspect AS text FROM units UNION SELECT raw_status FROM units WHERE raw_status IS NOT NULL),
codes AS (SELECT text, unicode(letter) % 16 AS place, 1 AS code FROM (SELECT text, unnest(string_split(text, '')) AS letter FROM texts))""",
)
ORACLES["one_to_one_merge"] = base("SELECT product_id, product_name, review_count FROM review_counts", False)
ORACLES["quality_flags_evaluation"] = base(
    f"""SELECT p.product_id, unnest([
  {{'code': 'HUMAN_EVALUATION_INCOMPLETE', 'severity': 'info', 'value': 'false', 'implication': 'completed_human_evaluation_available'}},
  {{'code': 'REVIEW_TIMESTAMPS_UNAVAILABLE', 'severity': 'warning', 'value': 'true', 'implication': 'freshness_and_temporal_drift_unavailable'}},
  {{'code': 'NORMALIZATION_RISK_CLUSTERS_PRESENT', 'severity': CASE WHEN coalesce(n, 0) > 0 THEN 'warning' ELSE 'info' END,
    'value': coalesce(n, 0)::VARCHAR, 'implication': 'inspect_cluster_lineage_before_high_stakes_use'}},
  {{'code': 'HUMAN_EVALUATION_RISK_COVERAGE_LIMITED', 'severity': CASE WHEN evaluated::DOUBLE / bounded < 0.5 THEN 'warning' ELSE 'info' END,
    'value': evaluated || '/' || bounded || '/' || {r('evaluated::DOUBLE / bounded')}, 'implication': 'sampled_cluster_scores_do_not_validate_all_risky_clusters'}},
  {{'code': 'HUMAN_EVALUATION_EVALUATOR_COUNT_AT_MINIMUM', 'severity': CASE WHEN raters = 3 THEN 'warning' ELSE 'info' END,
    'value': raters || '/3', 'implication': 'agreement_and_generalization_have_limited_precision'}}], recursive := true)
FROM products p LEFT JOIN (SELECT product_id, count(DISTINCT status_id) AS n FROM pv WHERE status_id IN (SELECT status_id FROM risky) GROUP BY 1) USING (product_id)
CROSS JOIN (SELECT count(*) AS bounded, count(*) FILTER (WHERE status_id < 'm') AS evaluated FROM risky)
CROSS JOIN (SELECT count(DISTINCT l_linenumber) AS raters FROM lineitem)""",
    True,
    """, risks AS (SELECT status_id, count(*) FILTER (WHERE vote = 'unknown')::DOUBLE / count(*) AS risk
  FROM pv WHERE status_id IS NOT NULL GROUP BY 1),
risky AS (SELECT status_id FROM risks WHERE risk > (SELECT avg(risk) FROM risks) + 1e-12)""",
)
ORACLES["staged_submissions"] = base(
    """SELECT 'review-' || substr(sha256('demo_ui|demo-' || review_id), 1, 16) AS review_id, 'demo_ui' AS source,
  'demo-' || review_id AS source_review_id, product_id::VARCHAR AS product_id, product_name, sha256(trim(review_text)) AS content_sha256,
  'demo-' || review_id AS demo_review_id, review_id AS ordinal FROM reviews JOIN products USING (product_id)""",
    False,
    by_customer=True,
)
ORACLES["repeated_responses"] = """
SELECT doc_id AS review_id, count(*) AS n FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels) GROUP BY 1 HAVING count(*) > 1"""
ORACLES["decision_excluded_products"] = base(
    """SELECT * EXCLUDE (rank), rank FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, candidate_name)::INTEGER AS rank
  FROM dscores WHERE (candidate_id + request_id) % 5 <> 0) WHERE rank <= 2""",
    True,
    DECISION,
)

# Names of an aspect whose ratio is 0.8 or more: the words before the noun, and the nouns for which that holds.
ALIKE = """
, alike(a, b, nouns) AS (VALUES ('cold', 'old', NULL), ('old', 'cold', NULL),
  ('large', 'red', ['anvil', 'gizmo', 'plate', 'widget']), ('red', 'large', ['anvil', 'gizmo', 'plate', 'widget']),
  ('hot', 'old', ['widget']), ('old', 'hot', ['widget']), ('new', 'red', ['widget']), ('red', 'new', ['widget']),
  ('old', 'red', ['widget']), ('red', 'old', ['widget'])),
said AS (SELECT DISTINCT aspect_id, split_part(raw_aspect, ' ', 1) AS word, sentiment IN ('negative', 'mixed') AS denied,
    CASE sentiment WHEN 'negative' THEN raw_aspect || ' 아님' WHEN 'mixed' THEN '안 ' || raw_aspect ELSE raw_aspect END AS text FROM units)"""
ORACLES["opposed_expressions"] = base(
    """SELECT n.aspect_id AS boundary, least(n.text, p.text) AS lo, greatest(n.text, p.text) AS hi
FROM said n JOIN said p ON n.aspect_id = p.aspect_id AND n.denied AND NOT p.denied
WHERE n.word = p.word OR EXISTS (SELECT 1 FROM alike k WHERE k.a = n.word AND k.b = p.word
  AND (k.nouns IS NULL OR list_contains(k.nouns, n.aspect_id)))""",
    False,
    ALIKE,
)
ORACLES["unit_fingerprints"] = base(
    """SELECT opinion_unit_id, sha256('{"opinion_unit_id":"' || opinion_unit_id || '","raw_aspect":"' || raw_aspect || '","raw_status":'
  || coalesce('"' || raw_status || '"', 'null') || ',"sentiment":"' || sentiment || '","unit_position":' || unit_position || '}') AS fingerprint
FROM units""",
    False,
)
_CHANGED = "FILTER (WHERE status_distance > 0)"
ORACLES["mapping_stats_changed"] = base(
    f"""SELECT product_id, aspect_id, aspect, count(*) AS eligible_opinion_unit_count, count(*) {_CHANGED} AS mapped_opinion_unit_count,
  {r(f'(count(*) {_CHANGED})::DOUBLE / count(*)')} AS mapping_rate,
  {r(f'quantile_cont(status_distance, 0.5) {_CHANGED}')} AS distance_p50,
  {r(f'quantile_cont(status_distance, 0.95) {_CHANGED}')} AS distance_p95, {r(f'max(status_distance) {_CHANGED}')} AS distance_max
FROM fact WHERE status_distance IS NOT NULL GROUP BY product_id, aspect_id, aspect""",
    False,
)
ORACLES["status_votes_known"] = base(
    f"""SELECT product_id, aspect_id, status_id, aspect, status, count(*) AS supporting_review_count, {COUNTS}
FROM pv WHERE status_id IS NOT NULL GROUP BY ALL"""
)


def _with_stats(body: str, keys: str, parts: list[str]) -> str:
    names = [key.strip() for key in keys.split(",")]
    columns = [
        f"{part}.{name} AS {part}_{name}"
        for part in parts
        for name in (
            "eligible_opinion_unit_count",
            "mapped_opinion_unit_count",
            "mapping_rate",
            "distance_p50",
            "distance_p95",
            "distance_max",
        )
    ]
    joins = "".join(
        f" JOIN ({stats(f'product_id, {keys}', part)}) {part} ON "
        + " AND ".join(f"m.{name} IS NOT DISTINCT FROM {part}.{name}" for name in ["product_id", *names])
        for part in parts
    )
    return f"SELECT m.*, {', '.join(columns)} FROM ({body}) m{joins}"


ORACLES["aspect_summary_rows"] = base(_with_stats(ASPECT_MATRIX, "aspect_id, aspect", ["aspect"]))
ORACLES["pair_summary_rows"] = base(
    _with_stats(PAIR_MATRIX, "aspect_id, status_id, aspect, status", ["aspect", "status"])
)
_KEYED = {
    "products": "SELECT 'p' || product_name AS key FROM products WHERE product_id IN (SELECT product_id FROM reviews)",
    "reviews": "SELECT review_id AS key FROM reviews",
    "opinion_units": "SELECT review_id * 100 + unit_position AS key FROM units JOIN reviews USING (review_id)",
    "representative_attributes": "SELECT review_id AS key FROM units JOIN reviews USING (review_id) WHERE unit_position = 1",
}
ORACLES["primary_keys"] = base(
    'SELECT "check", violations, violations = 0 AS passed FROM ('
    + " UNION ALL ".join(
        f"""SELECT '{name}_unique' AS "check", count(*) AS violations FROM (SELECT key FROM ({sql}) GROUP BY key HAVING count(*) > 1)
  UNION ALL SELECT '{name}_not_null', count(*) FROM ({sql}) WHERE key IS NULL"""
        for name, sql in _KEYED.items()
    )
    + ")",
    False,
)
ORACLES["contract_invariants"] = """SELECT unnest(['aspect_distributions', 'pair_distributions', 'similar_products', 'weakness_repairs',
  'aspect_evidence', 'aspect_evidence_limit', 'pair_evidence', 'pair_evidence_limit']) AS "check", 0 AS violations, true AS passed"""
ORACLES["review_times"] = base(
    """SELECT review_id, strftime(moment + INTERVAL 9 HOUR, '%Y%m%d-%H%M%S') AS shown,
  CASE WHEN review_id % 5 <> 0 THEN strftime(moment, '%Y%m%d-%H%M%S') END AS compact
FROM (SELECT review_id, created_at::TIMESTAMP + to_seconds(review_id % 86400) AS moment FROM reviews)""",
    False,
)
ORACLES["label_cells"] = """
SELECT p_partkey, replace(label, '|', chr(92) || '|') || '<br>' || p_type AS cell,
  '**' || replace(replace(label, '|', chr(92) || '|'), '*', chr(92) || '*') || '**' AS bold,
  CASE WHEN final = 0 THEN '는' ELSE '은' END AS topic, CASE WHEN final IS NULL OR final IN (0, 8) THEN '로' ELSE '으로' END AS direction,
  coalesce(printf('%.3f', share), '—') AS fixed, p_partkey || '(' || coalesce(printf('%.1f%%', share * 100), '—') || ')' AS share
FROM (SELECT p_partkey, p_type, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name || '|*' || chr((44032 + p_partkey % 11172)::INTEGER) END AS label,
    CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 11172 % 28 END AS final,
    CASE WHEN p_partkey % 7 > 0 THEN (p_partkey % 7) / 8.0::DOUBLE END AS share FROM part)"""
ORACLES["cluster_details_json"] = ORACLES["cluster_member_details"]
ORACLES["inbox_first_reviews"] = """
SELECT inbox_file, ordinal, doc_id::VARCHAR AS source_review_id, source AS product_id, lang AS category, length(text)::INTEGER AS n_chars
FROM (SELECT *, (doc_id // 10)::VARCHAR AS inbox_file, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) - 1 AS ordinal FROM documents)
WHERE ordinal < 4"""
ORACLES["parsed_attributes"] = """
SELECT doc_id, unit_position AS attribute_position, raw_aspect AS raw_attribute, sentiment FROM (
  SELECT doc_id, place::INTEGER AS unit_position, split_part(line, ' ', 1) AS raw_aspect,
    ['positive', 'negative', 'mixed', 'neutral', 'unknown', 'joyful'][length(line) % 6 + 1] AS sentiment
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents))"""


def _given(names: list[str]) -> str:
    """The statements of other queries as CTEs of their names."""
    return "WITH " + ", ".join(f"q_{name} AS MATERIALIZED ({ORACLES[name]})" for name in names)


ORACLES["static_report_facts"] = (
    _given(
        [
            "coverage_by_product",
            "normalization_reduction",
            "latest_review",
            "aspect_sentiment_matrix",
            "aspect_status_matrix",
            "most_debated_aspect",
            "sentiment_entropy",
            "similar_products",
            "source_weaknesses",
            "excluded_weaknesses",
            "weakness_repair_static",
            "condition_matches_static",
        ]
    )
    + """
SELECT c.product_id, c.product_name, c.review_count AS catalog_review_count, c.covered_review_count AS reviews_with_eligible_opinion_units,
  c.review_coverage_rate, c.opinion_unit_count, c.review_aspect_vote_count, c.review_aspect_status_vote_count,
  c.unique_aspect_count AS unique_aspect_cluster_count, c.unique_aspect_status_count AS unique_aspect_status_cluster_count,
  c.excluded_opinion_unit_count AS excluded_general_experience_opinion_unit_count,
  c.excluded_review_count AS excluded_general_experience_review_count,
  c.mean_units_per_covered_review AS mean_opinion_units_per_covered_review, n.raw_pair_count, n.status_decrease_rate,
  l.review_id AS latest_review_id, coalesce(l.names, '') AS latest_aspects, a.names AS aspects, p.n AS pair_count,
  d.aspect AS debated_aspect, d.positive_negative_rate_gap AS debated_gap, e.mixed_count AS mixed_vote_count,
  coalesce(s.names, '') AS similar_products,
  CASE WHEN w.names IS NULL THEN 'NO_HIGH_SUPPORT_NEGATIVE_ASPECT_STATUS_EVIDENCE' ELSE 'COMPLETED' END AS repair_status,
  coalesce(k.names, '') AS weaknesses, coalesce(x.n, 0) AS excluded_weakness_count, coalesce(w.names, '') AS alternatives,
  w.score AS best_score, m.reason AS first_reason,
  '[["price","inventory","shipping","promotion"],' || c.candidate_opinion_unit_count || ']' AS flag_values
FROM q_coverage_by_product c LEFT JOIN q_normalization_reduction n USING (product_id)
LEFT JOIN (SELECT product_id, review_id, string_agg(raw_aspect, ',' ORDER BY unit_position) AS names FROM q_latest_review GROUP BY 1, 2) l USING (product_id)
LEFT JOIN (SELECT product_id, string_agg(aspect_id, ',' ORDER BY rank) AS names FROM q_aspect_sentiment_matrix GROUP BY 1) a USING (product_id)
LEFT JOIN (SELECT product_id, count(*)::INTEGER AS n FROM q_aspect_status_matrix GROUP BY 1) p USING (product_id)
LEFT JOIN q_most_debated_aspect d USING (product_id)
LEFT JOIN (SELECT * FROM q_sentiment_entropy WHERE scope = 'review_aspect_vote') e USING (product_id)
LEFT JOIN (SELECT source_id AS product_id, string_agg(candidate_id::VARCHAR, ',' ORDER BY rank) AS names FROM q_similar_products GROUP BY 1) s USING (product_id)
LEFT JOIN (SELECT product_id, string_agg(status_id, ',' ORDER BY position) AS names FROM q_source_weaknesses GROUP BY 1) k USING (product_id)
LEFT JOIN (SELECT product_id, count(*)::INTEGER AS n FROM q_excluded_weaknesses GROUP BY 1) x USING (product_id)
LEFT JOIN (SELECT request_id AS product_id, string_agg(candidate_id::VARCHAR, ',' ORDER BY rank) AS names,
    max(score) FILTER (WHERE rank = 1) AS score FROM q_weakness_repair_static GROUP BY 1) w USING (product_id)
LEFT JOIN (SELECT request_id AS product_id, reason FROM q_condition_matches_static WHERE rank = 1 AND condition_id = 'weakness_1') m USING (product_id)"""
)
ORACLES["dynamic_report_facts"] = base(
    """SELECT v.review_id AS submission_id, p.product_name, coalesce(u.names, '') AS raw_aspects, coalesce(u.exact, 0) AS exact_mapped_opinion_unit_count,
  coalesce(u.pairs, 0) AS exact_mapped_aspect_status_count, coalesce(u.open, 0) AS unresolved_opinion_unit_count,
  coalesce(u.reasons, '') AS unresolved_reasons, coalesce(g.codes, '') AS relation_codes, g.first_negative AS first_other_negative_count,
  CASE WHEN a.names IS NOT NULL THEN 'COMPLETED' WHEN c.names IS NOT NULL THEN 'NO_CANDIDATE_WITH_REPAIR_EVIDENCE'
    WHEN e.n > 0 THEN 'NEGATIVE_INPUT_UNRESOLVED' ELSE 'NO_NEGATIVE_SUBMITTED_ASPECT_STATUS' END AS recommendation_status,
  coalesce(u.negative, 0) AS observed_negative_count, coalesce(c.names, '') AS conditions, coalesce(e.n, 0) AS excluded_condition_count,
  coalesce(a.names, '') AS alternatives, a.score AS best_score
FROM reviews v JOIN products p USING (product_id)
LEFT JOIN (SELECT review_id, string_agg(raw_aspect, ',' ORDER BY unit_position) AS names,
    count(*) FILTER (WHERE mapping_state = 'mapped_exact') AS exact, count(*) FILTER (WHERE mapping_state <> 'mapped_exact') AS open,
    count(DISTINCT aspect_id || '|' || status_id) FILTER (WHERE mapping_state = 'mapped_exact') AS pairs,
    count(*) FILTER (WHERE sentiment = 'negative')::INTEGER AS negative,
    string_agg(CASE mapping_state WHEN 'candidate' THEN 'CANDIDATE_HAS_NO_CANONICAL_ASPECT_STATUS' WHEN 'excluded_taxonomy' THEN 'EXCLUDED_FROM_TAXONOMY' END,
      ',' ORDER BY unit_position) AS reasons FROM catalog GROUP BY 1) u USING (review_id)
LEFT JOIN (SELECT submission_id, string_agg(relation_code, ',' ORDER BY rank) AS codes,
    max(other_negative_count) FILTER (WHERE rank = 1) AS first_negative FROM relations GROUP BY 1) g ON g.submission_id = v.review_id
LEFT JOIN (SELECT submission_id, string_agg(status_id, ',' ORDER BY position) AS names FROM sconditions GROUP BY 1) c ON c.submission_id = v.review_id
LEFT JOIN (SELECT submission_id, count(*)::INTEGER AS n FROM sexcluded GROUP BY 1) e ON e.submission_id = v.review_id
LEFT JOIN (SELECT request_id, string_agg(candidate_id::VARCHAR, ',' ORDER BY rank) AS names, max(score) FILTER (WHERE rank = 1) AS score
  FROM top_repairs GROUP BY 1) a ON a.request_id = v.review_id""",
    True,
    SUBMITTED + RELATIONS.removeprefix(GROUPS),
)
