"""Five related demo tables with unique, repeated and mismatched keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What the demo columns hold.
REGIONS = ("North", "South", "East", "West")
SEGMENTS = ("Retail", "SMB", "Enterprise")
SKUS = ("A100", "B200", "C300", "D400", "E500")
CARRIERS = ("DHL", "FedEx", "UPS")
CUSTOMERS, ORDERS = 200, 1_000


def demo_tables(spark: SparkSession, seed: int = 7, scale: int = 1) -> dict[str, DataFrame]:
    """``customers, orders, payments, order_items, shipments``.

    Every value is a hash of its row id and the seed, so a recomputed partition holds
    the same rows.  80 % of the orders ship, about 35 % are paid in 2 or 3 parts and
    each has 1 to 5 items.
    """
    n_customers, n_orders = CUSTOMERS * scale, ORDERS * scale

    def unit(tag: str, *ids: str) -> Column:
        """A number in [0, 1) that depends on the ids, the column and the seed."""
        bits = F.pmod(F.xxhash64(*map(F.col, ids), F.lit(tag), F.lit(seed)), F.lit(1 << 30))
        return bits / F.lit(float(1 << 30))

    def below(n: int, tag: str, *ids: str) -> Column:
        return F.floor(unit(tag, *ids) * n).cast("bigint")

    def pick(values: tuple[str, ...], tag: str, *ids: str) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (below(len(values), tag, *ids) + 1).cast("int"))

    def gamma(shape: int, scale_: float, tag: str, *ids: str) -> Column:
        """A sum of exponentials, which is gamma distributed for a whole shape."""
        terms = [-F.log(1 - unit(f"{tag}{n}", *ids)) for n in range(shape)]
        return F.round(sum(terms[1:], terms[0]) * scale_, 2)

    def day(start: str, tag: str, *ids: str) -> Column:
        return F.date_add(F.lit(start).cast("date"), below(365, tag, *ids).cast("int")).cast("timestamp")

    customers = spark.range(1, n_customers + 1).select(
        F.col("id").alias("customer_id"), pick(REGIONS, "region", "id").alias("region"),
        pick(SEGMENTS, "segment", "id").alias("segment"))
    orders = spark.range(1, n_orders + 1).select(
        F.col("id").alias("order_id"), (below(n_customers, "customer", "id") + 1).alias("customer_id"),
        day("2025-01-01", "ordered", "id").alias("order_date"), gamma(4, 60, "amount", "id").alias("amount"))

    def repeated(times: Column, most: int, id_name: str) -> DataFrame:
        """Each order 1 to ``most`` times, with a unique id."""
        part = F.explode(F.sequence(F.lit(1), times.cast("int"))).alias("part")
        rows = spark.range(1, n_orders + 1).withColumnRenamed("id", "order_id").select("order_id", part)
        return rows.withColumn(id_name, (F.col("order_id") - 1) * most + F.col("part"))

    parts = F.when(unit("split", "order_id") < 0.35, below(2, "parts", "order_id") + 2).otherwise(1)
    payments = repeated(parts, 3, "payment_id").select(
        "payment_id", "order_id", gamma(3, 40, "paid", "payment_id").alias("paid_amount"),
        day("2025-01-05", "paid_at", "payment_id").alias("paid_at"))
    items = repeated(below(5, "items", "order_id") + 1, 5, "item_id").select(
        "item_id", "order_id", pick(SKUS, "sku", "item_id").alias("sku"),
        (below(5, "qty", "item_id") + 1).alias("qty"))
    # a fixed 80 %: four of every five neighbouring orders, which one stays varies
    block = F.floor((F.col("order_id") - 1) / 5)
    skipped = F.pmod(F.xxhash64(block, F.lit("skip"), F.lit(seed)), F.lit(5))
    shipments = orders.where(F.pmod(F.col("order_id") - 1, F.lit(5)) != skipped).select(
        F.col("order_id").alias("shipment_id"), "order_id", "customer_id",
        pick(CARRIERS, "carrier", "order_id").alias("carrier"))
    return {"customers": customers, "orders": orders, "payments": payments, "order_items": items,
            "shipments": shipments}
