"""Precedence, duplicates and order over a whole relation of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .detect import ENTROPY, ENV

LOCATION = ["file", "line", "column", "field_path"]


def suppress(found: DataFrame) -> DataFrame:
    """At a location, specific rules remove the environment and the entropy rule, and the former the latter."""
    here = Window.partitionBy(*LOCATION)
    specific = F.max(~F.col("rule_id").isin(ENTROPY, ENV)).over(here)
    env = F.max(F.col("rule_id") == ENV).over(here)
    weak = F.col("rule_id").isin(ENTROPY, ENV) & F.col("__specific") | (F.col("rule_id") == ENTROPY) & F.col("__env")
    return found.withColumn("__specific", specific).withColumn("__env", env).where(~weak).drop("__specific", "__env")


def suppress_by_joins(found: DataFrame) -> DataFrame:
    """The same as two anti joins."""
    at = lambda df: df.select(*LOCATION).distinct()
    specific = at(found.where(~F.col("rule_id").isin(ENTROPY, ENV)))
    weak = found.where(F.col("rule_id").isin(ENTROPY, ENV)).join(specific, LOCATION, "left_anti")
    env = at(weak.where(F.col("rule_id") == ENV))
    entropy = weak.where(F.col("rule_id") == ENTROPY).join(env, LOCATION, "left_anti")
    return found.where(~F.col("rule_id").isin(ENTROPY, ENV)).unionByName(weak.where(F.col("rule_id") == ENV)).unionByName(entropy.select(*found.columns))


def first_of_each(found: DataFrame, *order: str) -> DataFrame:
    """The first finding of each rule at each location."""
    w = Window.partitionBy(*LOCATION, "rule_id").orderBy(*order)
    return found.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy("file", "line", "column", "rule_id", "field_path")


def ordered_errors(errors: DataFrame) -> DataFrame:
    return errors.orderBy("file", "message")
