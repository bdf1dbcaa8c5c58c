"""Synthetic demonstration tables: items, orders, parts, deliveries and customers, made by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import ranges

KINDS = ("items", "orders", "parts", "deliveries", "customers")
THINGS, LOOKS = ("lamp", "chair", "kettle", "radio", "boots"), ("plain", "robust", "light", "green", "folding")


def demo_table(spark: SparkSession, kind: str = "items", rows: int = 40) -> DataFrame:
    """One of the demonstration tables with `rows` rows."""
    if kind not in KINDS:
        raise ValueError(f"unknown table {kind!r}; there are {', '.join(KINDS)}")
    base = spark.range(rows).withColumn("id", F.col("id").cast("int"))
    pick = lambda values, step: F.get(F.array(*[F.lit(v) for v in values]), F.pmod(F.floor(F.col("id") / step), F.lit(len(values))))
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("id"))
    span = ranges.make(F.when(F.col("id") % 7 != 0, F.col("id")), F.when(F.col("id") % 5 != 0, F.col("id") + 10))
    if kind == "items":
        return base.select("id", F.concat_ws(" ", pick(LOOKS, 1), pick(THINGS, 5)).alias("description"), (1 + F.col("id") % 5).alias("rating"), pick(THINGS, 5).alias("category"), (F.col("id") % 3 != 0).alias("in_stock"),
                           F.to_json(F.struct(pick(("red", "blue"), 1).alias("color"), pick(("north", "south"), 2).alias("location"))).alias("metadata"), day.cast("timestamp_ntz").alias("created_at"), day.alias("last_updated_date"), span.alias("weight_range"),
                           F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.sin(F.col("id") + i).cast("float")).alias("embedding"))
    if kind == "orders":
        return base.select(F.col("id").alias("order_id"), (F.col("id") % 20).alias("product_id"), (1 + F.col("id") % 4).alias("order_quantity"), (F.col("id") * F.lit(1.25)).cast("decimal(10,2)").alias("order_total"), F.concat(F.lit("customer "), F.col("id") % 9).alias("customer_name"))
    if kind == "parts":
        return base.select(F.col("id").alias("part_id"), F.when(F.col("id") > 0, F.floor((F.col("id") - 1) / 2).cast("int")).alias("parent_part_id"), F.concat(F.lit("part "), F.col("id")).alias("description"))
    if kind == "deliveries":
        return base.select(F.col("id").alias("delivery_id"), span.alias("weights"), ranges.make(F.col("id").cast("long"), F.col("id").cast("long") * 2).alias("quantities"), ranges.make(day, F.date_add(day, 3)).alias("ship_dates"))
    return base.select("id", F.concat(F.lit("name "), F.col("id")).alias("name"), F.to_json(F.struct(F.struct((F.col("id") % 3).alias("level")).alias("status"))).alias("crm_data"))
