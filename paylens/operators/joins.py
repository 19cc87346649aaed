"""Join helpers (J-1, J-2): dimension lookups; join strategies are left to the planner and AQE."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens import constants as C


def hours_profile(spark) -> DataFrame:
    """SRC-6 business-hours profile as a DataFrame."""
    return spark.createDataFrame(C.BUSINESS_HOURS, "merchant_category string, open_hour int, close_hour int")


def join_business_hours(tx: DataFrame, profile: DataFrame) -> DataFrame:
    """J-1 with a profile given as data: left join (planner and AQE pick the strategy by size), 8/20 default."""
    h = F.hour("timestamp")
    return (tx.drop("is_outside_business_hours").join(profile, "merchant_category", "left")
            .withColumn("is_outside_business_hours",
                        (h < F.coalesce("open_hour", F.lit(C.DEFAULT_OPEN_HOUR)))
                        | (h > F.coalesce("close_hour", F.lit(C.DEFAULT_CLOSE_HOUR))))
            .drop("open_hour", "close_hour"))


def merchant_dimension(tx: DataFrame) -> DataFrame:
    """J-2 dimension: one row per merchant with its newest attributes."""
    from paylens.operators.features import latest_snapshot
    return latest_snapshot(tx.select("merchant_id", "timestamp", "transaction_id", "merchant_abn",
                                     "merchant_category", "state")).drop("timestamp", "transaction_id")


def attach_merchant_dim(facts: DataFrame, dim: DataFrame) -> DataFrame:
    """J-2: equi join on merchant_id (planner/AQE pick broadcast or sort-merge by size)."""
    return facts.join(dim, "merchant_id", "left")
