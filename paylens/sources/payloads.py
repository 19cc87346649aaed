"""Payload parsers (SRC-4, SRC-5) and ratio coercion (P-6, P-7, P-8, P-13, U-2).

Column maxima used by the scaling rules are scalar subqueries (one aggregate
row), so the rules stay one distributed pass over any table size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANONICAL = ["month", "contactless_ratio", "debit_ratio", "fraud_rate"]
OBS_LIST = "struct<data: struct<observations: array<map<string, string>>>>"
OBS_MAP = "struct<data: struct<observations: map<string, string>>>"


def parse_statistical_payload(payloads: DataFrame, col: str = "payload", text: bool = False) -> DataFrame:
    """SRC-4: JSON payload -> (TIME_PERIOD, OBS_VALUE, MEASURE, FREQUENCY).

    List form: rows kept as they are, values unconverted in ``OBS_TEXT`` and as
    numbers where they are numbers, if some observation of the payload has the
    one key and some the other (the columns of the payload's table).  Dict form: key -> object or bare number;
    the period falls back to the key; values are coerced to numbers and rows
    without a number dropped.  A zero OBS_VALUE inside an object without a
    lower-case twin is treated as missing, as falsy values are in the source
    rule; a bare zero is kept.
    """
    txt = F.col(col)
    lst = F.from_json(txt, OBS_LIST)["data"]["observations"]
    mp = F.from_json(txt, OBS_MAP)["data"]["observations"]
    is_list = F.coalesce(F.trim(F.get_json_object(txt, "$.data.observations")).startswith("["), F.lit(False))
    def some(key: str) -> Column:
        return F.exists(lst, lambda o: F.coalesce(F.map_contains_key(o, key), F.lit(False)))

    list_rows = (payloads.filter(is_list & some("TIME_PERIOD") & some("OBS_VALUE"))
                 .select(F.explode(lst).alias("o"))
                 .select(F.try_element_at("o", F.lit("TIME_PERIOD")).alias("TIME_PERIOD"),
                         F.try_element_at("o", F.lit("OBS_VALUE")).alias("OBS_TEXT"))
                 .withColumn("OBS_VALUE", F.col("OBS_TEXT").try_cast("double")))
    entries = payloads.filter(~is_list).select(F.explode(mp).alias("k", "v"))
    obj = F.from_json(F.col("v"), "map<string,string>")     # exact-case key lookups
    is_obj = F.coalesce(F.trim(F.col("v")).startswith("{"), F.lit(False))

    def truthy(c: Column) -> Column:
        num = c.try_cast("double")
        return F.when(c.isNull() | (c == "") | (num == 0), F.lit(None)).otherwise(c)

    period = F.when(is_obj, F.coalesce(truthy(obj["TIME_PERIOD"]), truthy(obj["time_period"]), F.col("k"))) \
              .otherwise(F.col("k"))
    raw_val = F.when(is_obj, F.coalesce(truthy(obj["OBS_VALUE"]), truthy(obj["obs_value"]))).otherwise(F.col("v"))
    dict_rows = (entries.select(period.alias("TIME_PERIOD"), raw_val.alias("OBS_TEXT"),
                                raw_val.try_cast("double").alias("OBS_VALUE"))
                 .filter(F.col("OBS_VALUE").isNotNull()))
    rows = list_rows.unionByName(dict_rows).select("TIME_PERIOD", "OBS_VALUE", "OBS_TEXT")
    return rows.withColumn("MEASURE", F.lit("index")).withColumn("FREQUENCY", F.lit("M")) \
               .select("TIME_PERIOD", "OBS_VALUE", "MEASURE", "FREQUENCY", *(["OBS_TEXT"] if text else []))


def pick_column(columns: list[str], tokens: list[str]) -> str | None:
    """P-7: the first column whose lower-cased, trimmed name contains every token."""
    for c in columns:
        low = c.strip().lower()
        if all(t in low for t in tokens):
            return c
    return None


def _numeric_text(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c.cast("string"), "%", ""), ",", "").try_cast("double")


def coerce_ratio(df: DataFrame, column: str) -> Column:
    """P-6: strip % and ','; when the column maximum exceeds 1 divide the whole column by 100; clip."""
    v = _numeric_text(F.col(column))
    mx = df.select(F.max(_numeric_text(F.col(column)))).scalar()
    scaled = F.when(mx > 1.0, v / 100.0).otherwise(v)
    return F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))


def coerce_fraud_rate(df: DataFrame, column: str) -> Column:
    """P-8: maximum > 100 -> /10,000; maximum > 1 -> /100; clip to [0, 1]."""
    v = _numeric_text(F.col(column))
    mx = df.select(F.max(_numeric_text(F.col(column)))).scalar()
    scaled = F.when(mx > 100, v / 10_000.0).when(mx > 1, v / 100.0).otherwise(v)
    return F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))


def parse_card_ratio_table(df: DataFrame, order_col: str | None = None) -> DataFrame:
    """SRC-5: arbitrary CSV columns -> canonical monthly ratios.

    Columns are found by tokens (P-7); without a month column the first column
    is used; a missing ratio column yields an empty table.  Months are
    normalised to yyyy-MM (P-13), rows with a null drop, the first row per month
    in input order is kept (U-2; ``order_col`` gives the order, else the file
    row order via monotonically_increasing_id on a single small file).
    """
    cols = df.columns
    month = pick_column(cols, ["month", "date", "period"]) or (cols[0] if cols else None)
    contactless, debit, fraud = (pick_column(cols, ["contactless"]), pick_column(cols, ["debit"]),
                                 pick_column(cols, ["fraud"]))
    empty = df.sparkSession.createDataFrame(
        [], "month string, contactless_ratio double, debit_ratio double, fraud_rate double")
    if not (contactless and debit and fraud) or month is None:
        return empty
    ordered = df.withColumn("_ord", F.col(order_col) if order_col else F.monotonically_increasing_id())
    out = ordered.select(
        "_ord",
        F.date_format(F.col(month).cast("string").try_cast("timestamp_ntz"), "yyyy-MM").alias("month"),
        coerce_ratio(df, contactless).alias("contactless_ratio"),
        coerce_ratio(df, debit).alias("debit_ratio"),
        coerce_fraud_rate(df, fraud).alias("fraud_rate"),
    ).dropna(subset=CANONICAL)
    first = Window.partitionBy("month").orderBy("_ord")
    return (out.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") == 1)
            .drop("_rn", "_ord").orderBy("month"))
