"""Prices of models: items joined with a price table that has a default row, task totals and breakdowns."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Model, price of a million tokens of text, of audio and of output. A model that isn't listed takes the row `default`.
PRICES = [
    ("gemini-3.5-flash", 1.50, 1.50, 9.00),
    ("gemini-2.5-flash", 0.30, 1.00, 2.50),
    ("gemini-1.5-pro-latest", 1.25, 2.50, 10.00),
    ("default", 0.30, 1.00, 2.50),
]


def price_table(spark: SparkSession, rows=PRICES) -> DataFrame:
    return spark.createDataFrame(rows, "model string, text double, audio double, output double")


def priced(items: DataFrame, prices: DataFrame) -> DataFrame:
    """items (model, input_tokens, output_tokens, content_type) with input_cost, output_cost and cost. Null tokens are 0; every content type but audio is text. Of a model listed
    twice the greater prices count.

    The price table is a dimension of a few rows and is broadcast by a hint: rows made in the session have no size that Spark knows, and items dealt by model would meet in a few
    tasks. Its default row is one scalar subquery."""
    rates = F.struct("text", "audio", "output")
    default = prices.where("model = 'default'").agg(F.max(rates).alias("d")).scalar()
    side = prices.groupBy(F.col("model").alias("_m")).agg(F.max(rates).alias("_rates"))
    met = items.join(F.broadcast(side), items["model"] == F.col("_m"), "left").withColumn("_rates", F.coalesce("_rates", default))
    into, out = (F.coalesce(c, F.lit(0)) for c in ("input_tokens", "output_tokens"))
    input_cost = into / F.lit(1e6) * F.when(F.col("content_type") == "audio", F.col("_rates.audio")).otherwise(F.col("_rates.text"))
    met = met.withColumn("input_cost", input_cost).withColumn("output_cost", out / F.lit(1e6) * F.col("_rates.output"))
    return met.withColumn("cost", F.col("input_cost") + F.col("output_cost")).drop("_m", "_rates")


#: Fixed value: what is left of the costs of a task that the cheaper tier (or a batch) has done.
DISCOUNT = 0.5


#: Items that a task sums at most, about; more than the session's partitions hold are dealt to more tasks.
TASK_ROWS = 500_000


def dealt(items: DataFrame, key: str) -> DataFrame:
    """items dealt by key to so many tasks that each has about TASK_ROWS; where the session's own partitions are enough, Spark deals them. One counting pass over the items."""
    tasks = math.ceil(items.count() / TASK_ROWS)
    return items.repartition(tasks, key) if tasks > int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")) else items


def totals(items: DataFrame, key: str, order: str, flex: str | None = None) -> DataFrame:
    """priced() items summed by task: tokens, costs, and breakdown, the items in order. With flex, a flag of items, the costs of a task with a true one are halved; the
    breakdown keeps the full ones."""
    n = lambda c: F.coalesce(c, F.lit(0))
    row = F.struct(F.col(order).alias("place"), "content_type", n("input_tokens").alias("input_tokens"), n("output_tokens").alias("output_tokens"), "cost")
    factor = F.when(F.bool_or(F.coalesce(flex, F.lit(False))), DISCOUNT).otherwise(1.0) if flex else F.lit(1.0)
    sums = [F.sum(n(c)).alias(c) for c in ("input_tokens", "output_tokens")] + [(F.sum(n(c)) * factor).alias(c) for c in ("input_cost", "output_cost", "cost")]
    return dealt(items, key).groupBy(key).agg(F.sum(n("input_tokens") + n("output_tokens")).alias("tokens"), *sums, F.array_sort(F.collect_list(row)).alias("breakdown"))
