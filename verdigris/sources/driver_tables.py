"""Reshape the given benchmark tables into catalog tables (products, reviews, opinion units)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sentiment import first_match
from ..operators.taxonomy import sequential_numbers
from ..schemas import CANDIDATE, EXCLUDED, MAPPED_EXACT, SENTIMENTS
from ..session import cut_and_deal, cut_lineage


NATION, CUSTOMER = "nation", "customer"
#: Rows of a task in which lines are numbered and meet their review; sorted several times, each takes about 1 KB.
ROWS_OF_TASK = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """Rows (``rows`` many, else counted) dealt by ``key`` so that a task has about ``ROWS_OF_TASK`` of them.

    Left to itself adaptive execution merges partitions by their compressed bytes, and the memory of a task grows with
    the table. What a task of each core holds anyway stays as it is.
    """
    tasks = -(-(df.count() if rows is None else rows) // ROWS_OF_TASK)
    return df.repartition(tasks, key) if tasks > df.sparkSession.sparkContext.defaultParallelism else df


def met(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Rows of two tables that have the same ``key``.

    What one task may hold anyway is sent to all tasks, also where Spark would rather sort it with the left side in
    partitions merged by bytes. A larger table isn't sent: both sides are dealt by the key, so that the tasks of the
    join don't grow with the tables either.
    """
    found = right.count()
    if found <= ROWS_OF_TASK:
        return left.join(F.broadcast(right), key, how)
    tasks = -(-max(left.count(), found) // ROWS_OF_TASK)
    return left.repartition(tasks, key).join(right.repartition(tasks, key).hint("merge"), key, how)


def line_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks over which the lines are dealt: one for ``ROWS_OF_TASK`` lines, one for each core at least."""
    lines = table(spark, sf_dir, "lineitem").count()
    return max(spark.sparkContext.defaultParallelism, -(-lines // ROWS_OF_TASK))


def review_buckets(spark: SparkSession, sf_dir: str) -> int:
    """Buckets of tables that lie dealt by review and meet others: with fewer than its shuffle partitions Spark would deal
    them again.
    """
    return max(line_tasks(spark, sf_dir), int(spark.conf.get("spark.sql.shuffle.partitions")))


def products(spark: SparkSession, sf_dir: str, by: str = NATION) -> DataFrame:
    if by == CUSTOMER:
        return table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("product_id"),
            F.col("c_name").alias("product_name"),
            F.col("c_mktsegment").alias("category"),
        )
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("product_id"),
        F.col("n_name").alias("product_name"),
        F.col("n_regionkey").alias("category"),
    )


def reviews(spark: SparkSession, sf_dir: str, by: str = NATION) -> DataFrame:
    """One review per order; its product is the customer's nation, or the customer."""
    orders = table(spark, sf_dir, "orders")
    if by == CUSTOMER:
        orders = orders.withColumn("product_id", F.col("o_custkey"))
    else:
        customers = table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("product_id")
        )
        orders = met(orders, customers, "o_custkey")
    return orders.select(
        F.col("o_orderkey").alias("review_id"),
        "product_id",
        F.concat_ws(" ", "o_orderpriority", F.lit("order"), "o_orderkey").alias("review_text"),
        F.col("o_orderdate").alias("created_at"),
    )


def dealt_reviews(spark: SparkSession, sf_dir: str, by: str = NATION) -> DataFrame:
    """The reviews, dealt by their id."""
    return dealt(reviews(spark, sf_dir, by), "review_id", table(spark, sf_dir, "orders").count())


def units(spark: SparkSession, sf_dir: str, numbered: bool = True, tasks: int | None = None) -> DataFrame:
    """One opinion unit per line item, numbered within its review.

    For what reads no number, ``numbered`` can be false; then lines aren't dealt by their review. With ``tasks`` they are
    dealt over so many, for units that are written in as many buckets.
    """
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), "p_name", "p_type"
    )
    aspect = F.substring_index("p_name", " ", -1)
    has_status = F.col("p_type") != "PROMO"
    order = W.partitionBy("l_orderkey").orderBy(
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_shipdate",
        "l_extendedprice",
        "l_tax",
        "l_discount",
    )
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.count()
    # A line without a part has a number all the same, so it leaves after the numbering.
    large = part.count() > ROWS_OF_TASK
    if large:
        lines = met(lines, part.withColumn("known", F.lit(True)), "l_partkey", "left")
    if numbered:
        lines = lines.repartition(tasks, "l_orderkey") if tasks else dealt(lines, "l_orderkey", rows)
    lines = lines.withColumn("unit_position", F.row_number().over(order))
    lines = lines.filter("known") if large else lines.join(F.broadcast(part), "l_partkey")
    return lines.select(
        F.concat_ws("-", "l_orderkey", "unit_position").alias("opinion_unit_id"),
        F.when(
            F.col("l_linestatus") == "F", F.col("l_orderkey") * 100 + F.col("unit_position")
        ).alias("source_opinion_unit_idx"),
        F.col("l_orderkey").alias("review_id"),
        "unit_position",
        F.col("p_name").alias("raw_aspect"),
        F.when(has_status, F.concat_ws("/", "p_type", "l_linestatus")).alias("raw_status"),
        F.concat_ws(" ", F.lit("order"), "l_orderkey").alias("excerpt"),
        F.concat_ws(" ", "p_name", F.lower("p_type")).alias("opinion"),
        first_match(
            [
                (F.col("l_tax") >= 0.08, F.lit("unknown")),
                (F.col("l_returnflag") == "R", F.lit("negative")),
                (F.col("l_returnflag") == "N", F.lit("positive")),
                (F.col("l_discount") >= 0.06, F.lit("mixed")),
            ],
            F.lit("neutral"),
        ).alias("sentiment"),
        first_match(
            [
                (aspect == "anvil", F.lit(EXCLUDED)),
                (F.col("l_quantity") > 45, F.lit(CANDIDATE)),
            ],
            F.lit(MAPPED_EXACT),
        ).alias("mapping_state"),
        aspect.alias("aspect_id"),
        aspect.alias("aspect"),
        F.when(has_status, F.concat_ws(":", aspect, "p_type")).alias("status_id"),
        F.when(has_status, F.col("p_type")).alias("status"),
        F.col("l_discount").alias("aspect_distance"),
        F.when(has_status, F.col("l_tax")).alias("status_distance"),
    )


def catalog_units(spark: SparkSession, sf_dir: str, by: str = NATION) -> DataFrame:
    """All opinion units with their review's product, whatever their mapping state."""
    return units(spark, sf_dir).join(reviews(spark, sf_dir, by), "review_id")


def mapped_units(spark: SparkSession, sf_dir: str, by: str = NATION) -> DataFrame:
    """Only exact canonical mappings take part in catalog statistics."""
    return catalog_units(spark, sf_dir, by).filter(F.col("mapping_state") == MAPPED_EXACT)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements as a caller would send them, some by label, some by id, some wrong.

    Every unit is a requirement of its review's request. Units without a canonical mapping give
    their raw aspect, mixed opinions give their raw status, and the second unit of a review names
    one fixed status type that need not be its own.
    """
    mapped = F.col("mapping_state") == MAPPED_EXACT
    position = F.col("unit_position")
    return catalog_units(spark, sf_dir).select(
        F.col("review_id").alias("request_id"),
        F.col("product_id").alias("source_id"),
        F.concat(F.lit("r"), position).alias("requirement_id"),
        F.when(mapped, F.col("aspect")).otherwise(F.col("raw_aspect")).alias("aspect"),
        F.when(F.col("sentiment") == "mixed", F.col("raw_status"))
        .otherwise(F.col("status"))
        .alias("status"),
        "sentiment",
        F.when(F.col("source_opinion_unit_idx").isNotNull(), F.col("aspect_id")).alias(
            "aspect_cluster_id"
        ),
        F.when(position == 1, F.col("status_id"))
        .when(position == 2, F.concat_ws(":", "aspect", F.lit("MEDIUM")))
        .alias("status_cluster_id"),
        F.lit(1.0).alias("importance"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions with vectors: text, boundary, review count and unit-length embedding.

    The review count of an expression is the number of events of the user with its number.
    """
    seen = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("vec_id"))
        .agg(F.count(F.lit(1)).alias("unique_review_count"))
    )
    return (
        table(spark, sf_dir, "embeddings")
        .join(seen, "vec_id", "left")
        .select(
            "vec_id",
            F.format_string("e%06d", F.col("vec_id")).alias("text"),
            F.col("label").alias("boundary"),
            F.coalesce("unique_review_count", F.lit(1).cast("long")).alias("unique_review_count"),
            F.col("embedding").cast("array<double>").alias("embedding"),
        )
    )


def clustered_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions with a given cluster: the boundary and the signs of two vector components."""
    sign = [(F.col("embedding")[i] > 0).cast("int").cast("string") for i in (0, 1)]
    return embeddings(spark, sf_dir).withColumn(
        "cluster_id", F.concat_ws("-", F.lit("C"), F.col("boundary"), *sign)
    )


def _borrowed_vectors(texts: DataFrame, order: str, vectors: DataFrame) -> DataFrame:
    """Texts numbered in order take the same-numbered vector; behind the last one they begin anew."""
    numbered = sequential_numbers(texts, [order], "number")
    ids = vectors.select("vec_id", "embedding")
    count = F.broadcast(ids.agg(F.max("vec_id").alias("last")))
    placed = numbered.join(count).withColumn("vec_id", (F.col("number") - 1) % (F.col("last") + 1))
    return placed.join(ids, "vec_id").drop("vec_id", "number", "last")


def canonical_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct canonical aspects and statuses of exactly mapped units."""
    exact = units(spark, sf_dir, numbered=False).filter(F.col("mapping_state") == MAPPED_EXACT)
    return exact.select("aspect_id", "aspect", "status_id", "status").distinct()


def status_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector for every canonical status: statuses numbered in order take the same-numbered one."""
    known = cut_lineage(canonical_pairs(spark, sf_dir))  # numbering reads its rows more than once
    pairs = known.filter(F.col("status_id").isNotNull()).select("aspect_id", "status_id", "status").distinct()
    return _borrowed_vectors(pairs, "status_id", embeddings(spark, sf_dir))


def text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector for every raw expression: texts numbered in order take the same-numbered one."""
    raw = units(spark, sf_dir)
    texts = (
        raw.select(F.col("raw_aspect").alias("text"))
        .unionByName(raw.select(F.col("raw_status").alias("text")))
        .filter(F.col("text").isNotNull())
        .distinct()
    )
    return _borrowed_vectors(texts, "text", embeddings(spark, sf_dir))


# Raw aspects kept out of the taxonomy in the adapted data.
EXCLUDED_ASPECTS = tuple(
    f"{colour} anvil" for colour in ("blue", "cold", "hot", "large", "new", "old", "red", "small")
)
CANDIDATE_THRESHOLD = 1.2


def _often(counted: DataFrame) -> DataFrame:
    """Rows whose count ``n`` is the average or more."""
    average = F.broadcast(counted.agg(F.avg("n").alias("average")))
    return counted.join(average, F.col("n") >= F.col("average")).drop("average")


def mapping_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A taxonomy that knows part of the vocabulary, so that exact, candidate and miss all occur.

    It was made from the captured units: it has the raw aspects that were captured as often as the average one or
    more, and inside them the raw statuses of which the same holds.
    """
    vectors = text_vectors(spark, sf_dir)
    captured = units(spark, sf_dir).filter(
        F.col("source_opinion_unit_idx").isNotNull() & ~F.col("raw_aspect").isin(*EXCLUDED_ASPECTS)
    )
    names = ["raw_aspect", "raw_status", "aspect_id", "aspect", "status_id", "status"]
    seen = cut_lineage(captured.groupBy(*names).agg(F.count(F.lit(1)).alias("n")))
    aspects = _often(seen.groupBy("raw_aspect").agg(F.sum("n").alias("n"))).select("raw_aspect")
    known = seen.join(aspects, "raw_aspect")
    threshold = F.lit(CANDIDATE_THRESHOLD).alias("distance_threshold")
    aspect_members = (
        known.select("raw_aspect", "aspect_id", "aspect")
        .distinct()
        .withColumnRenamed("raw_aspect", "text")
        .join(vectors, "text")
        .select(F.col("aspect_id").alias("cluster_id"), "aspect", "text", "embedding", threshold)
    )
    status_members = (
        _often(
            known.filter(F.col("raw_status").isNotNull())
            .groupBy("aspect_id", "raw_status", "status_id", "status")
            .agg(F.sum("n").alias("n"))
        )
        .select("aspect_id", "raw_status", "status_id", "status")
        .withColumnRenamed("raw_status", "text")
        .join(vectors, "text")
        .select(
            F.col("aspect_id").alias("boundary"),
            F.col("status_id").alias("cluster_id"),
            "status",
            "text",
            "embedding",
            threshold,
        )
    )
    return {"aspect_members": aspect_members, "status_members": status_members, "vectors": vectors}


def document_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as an inbox of reviews; their source is the product, their language the category."""
    return table(spark, sf_dir, "documents").select(
        F.lit(None).cast("string").alias("source"),
        F.col("doc_id").cast("string").alias("source_review_id"),
        F.col("source").alias("product_id"),
        F.upper("source").alias("product_name"),
        F.col("lang").alias("category"),
        F.col("text").alias("review_text"),
        F.col("doc_id").alias("ordinal"),
    )


def document_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document as an extracted unit; some break a rule.

    The sentiment follows the length of the line and is invalid for one length in six; the excerpt
    of one length in seven has a mark that is not in the document.
    """
    lines = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.posexplode(F.split("text", "\n")).alias("place", "line")
    )
    word = F.split("line", " ")
    length = F.length("line")
    labels = F.array(*[F.lit(name) for name in (*SENTIMENTS, "joyful")])
    return lines.select(
        "doc_id",
        F.col("text").alias("review_text"),
        (F.col("place") + 1).alias("unit_position"),
        word[0].alias("raw_aspect"),
        F.get(word, F.lit(1)).alias("raw_status"),
        F.when(length % 7 == 0, F.concat("line", F.lit("#"))).otherwise(F.col("line")).alias("excerpt"),
        F.col("line").alias("opinion"),
        F.get(labels, length % 6).alias("sentiment"),
    )


def document_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units of each document as one stored JSON response."""
    unit = F.struct("raw_aspect", "raw_status", "excerpt", "opinion", "sentiment")
    placed = F.struct("unit_position", unit.alias("unit"))
    return (
        document_units(spark, sf_dir)
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(placed)).alias("units"))
        .select("doc_id", F.to_json(F.struct(F.col("units.unit").alias("opinion_units"))).alias("response"))
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as ratings: supplier = item, line number = rater and arm, discount = score."""
    number = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("item_id"),
        number.alias("rater_id"),
        F.substring(F.lit("ABCD"), number % 4 + 1, F.lit(1)).alias("arm"),
        (F.round(F.col("l_discount") * 100).cast("int") % 5 + 1).alias("score"),
        (F.col("l_returnflag") == "R").alias("preferred"),
    )


def bundle(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The catalog as a delivered bundle: only exactly mapped units have an assignment.

    Units and reviews are written dealt by review, as several files come from each.
    """
    buckets = review_buckets(spark, sf_dir)
    rows = units(spark, sf_dir, tasks=buckets).drop("opinion_unit_id", "source_opinion_unit_idx")
    own = cut_and_deal(rows, "review_id", buckets)
    names = products(spark, sf_dir).select("product_id", "product_name")
    texts = cut_and_deal(
        reviews(spark, sf_dir).join(names, "product_id").select("review_id", "product_name", "review_text"), "review_id", buckets
    )
    number = F.col("review_id") * 100 + F.col("unit_position")
    numbered = own.withColumn("idx", number).withColumn("review_idx", F.col("review_id"))
    exact = numbered.filter(F.col("mapping_state") == MAPPED_EXACT)
    return {
        "reviews": texts.select(
            F.col("review_id").alias("idx"), F.col("product_name").alias("productName"), F.col("review_text").alias("review")
        ),
        "opinion_units": numbered.select(
            "idx", "review_idx", "raw_aspect", "raw_status", "excerpt", "opinion", "sentiment"
        ),
        "representative_attributes": numbered.filter("unit_position = 1").select(
            "idx", "review_idx", F.col("raw_aspect").alias("raw_attribute"), "sentiment"
        ),
        "assignments": dealt(exact, "idx", table(spark, sf_dir, "lineitem").count()).select(
            "idx",
            F.col("aspect_id").alias("aspect_cluster_id"),
            "aspect",
            F.col("status_id").alias("status_cluster_id"),
            "status",
            F.col("aspect_distance").alias("aspect_mapping_distance"),
            F.col("status_distance").alias("status_mapping_distance"),
        ),
        "responses": texts.select(
            F.col("review_id").alias("review_idx"), F.sha2(F.concat(F.lit("response "), "review_text"), 256).alias("response_sha256")
        ),
    }
