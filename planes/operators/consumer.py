"""What the receiving side does with delivered batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from planes.operators.usage import KIND_MODEL
from planes.schemas import COST, USAGE_SCHEMA_VERSION


def drop_replays(facts: DataFrame, high_water: DataFrame) -> DataFrame:
    """Facts above each source's high-water mark, each seq once. Seq 0 is invalid."""
    marks = high_water.select("source_id", F.col("hwm").alias("_hwm"))
    fresh = facts.filter(F.col("seq") > 0).join(marks, "source_id", "left")
    fresh = fresh.filter(F.col("seq") > F.coalesce("_hwm", F.lit(0))).drop("_hwm")
    return fresh.dropDuplicates(["source_id", "seq"])


def next_high_water(high_water: DataFrame, accepted: DataFrame) -> DataFrame:
    seen = accepted.groupBy("source_id").agg(F.max("seq").alias("hwm"))
    return high_water.select("source_id", "hwm").unionByName(seen).groupBy("source_id").agg(
        F.max("hwm").alias("hwm")
    )


def validate(facts: DataFrame) -> DataFrame:
    """Add ``verdict``: accepted, or why a fact is quarantined."""
    return facts.withColumn(
        "verdict",
        F.when(F.col("schema_version") != USAGE_SCHEMA_VERSION, "schema_version")
        .when(F.col("kind") != KIND_MODEL, "kind")
        .otherwise("accepted"),
    )


def facts_of(batches: DataFrame) -> DataFrame:
    return batches.select("source_id", "schema_version", F.inline("facts"))


def spend_rows(facts: DataFrame) -> DataFrame:
    """One spend row per fact, marked as an estimate."""
    return facts.withColumn("cost_usd", F.col("cost_usd_estimate").cast(COST)).drop(
        "cost_usd_estimate"
    ).withColumn("source", F.lit("estimated"))


def step_spend(steps: DataFrame, spend: DataFrame) -> DataFrame:
    """Events and spend per (run_id, step_id); a step nothing was spent on has zeros.

    Both sides are reduced to the key before they meet, so a hot step costs no more than
    any other.
    """
    key = ["run_id", "step_id"]
    named = (F.col("run_id") != "") & (F.col("step_id") != "")
    events = steps.filter(named).groupBy(*key).agg(F.count(F.lit(1)).alias("events"))
    cost = spend.filter(named).groupBy(*key).agg(
        F.count(F.lit(1)).alias("facts"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("cost_usd").cast(COST).alias("cost_usd"),
    )
    joined = events.join(cost, key, "left")
    return joined.na.fill(0, ["facts", "input_tokens", "output_tokens"]).withColumn(
        "cost_usd", F.coalesce("cost_usd", F.lit(0).cast(COST))
    )
