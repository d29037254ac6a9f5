"""Form-like documents rendered from the star schema, as no table holds real ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One invoice text for each order: o_orderkey, text.

    By order key some lack their vendor label (7), have filler for a number (11), a
    date that is none (13), or a total that is off (5).
    """
    t = lambda n: table(spark, sf_dir, n)
    key = F.col("o_orderkey")
    lines = (
        t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_extendedprice"),
            F.format_string("Part %d %d $%.2f $%.2f", "p_partkey", F.col("l_quantity").cast("int"), F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2), "l_extendedprice").alias("line"),
        )
        .groupBy("l_orderkey")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "line"))), lambda x: x["line"]), "\n").alias("items"), F.round(F.sum("l_extendedprice"), 2).alias("subtotal"))
    )
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    vendor = F.concat(F.lit("Vendor: Supplier "), (key % 97).cast("string"))
    number = F.when(key % 11 == 0, "________").otherwise(F.concat(F.lit("INV-"), key.cast("string")))
    date = F.when(key % 13 == 0, "2024-99-01").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    tax = F.round(F.col("subtotal") * 0.08, 2)
    total = F.round(F.col("subtotal") + tax + F.when(key % 5 == 0, 1.0).otherwise(0.0), 2)
    text = F.concat_ws(
        "\n",
        F.when(key % 7 == 0, F.concat(F.lit("Supplier "), (key % 97).cast("string"), F.lit(" Ltd"))).otherwise(vendor),
        F.lit("INVOICE"),
        F.concat(F.lit("Invoice Number: "), number), F.concat(F.lit("Invoice Date: "), date),
        F.concat(F.lit("Bill To: "), F.col("c_name")), F.lit("Payment Terms: Net 30"), F.lit("Item Qty Price Amount"),
        F.col("items"),
        F.format_string("Subtotal: $%.2f", "subtotal"), F.format_string("Tax: $%.2f", tax), F.format_string("Total: $%.2f", total),
        F.lit("Currency: USD"),
    )
    return rows.select("o_orderkey", text.alias("text"))


def ndas(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    text = F.concat_ws(
        "\n",
        F.when(key % 3 == 0, "MUTUAL NON-DISCLOSURE AGREEMENT").when(key % 3 == 1, "ONE-WAY NON-DISCLOSURE AGREEMENT").otherwise("AGREEMENT"),
        F.lit("Effective Date: 2024-03-05"), F.concat(F.lit("Disclosing Party: "), F.col("c_name")),
        F.when(key % 5 == 0, "Receiving Party: ______").otherwise(F.concat(F.lit("Receiving Party: Partner "), key.cast("string"))),
        F.concat(F.lit("governed by the laws of "), F.col("n_name"), F.lit(".")), F.concat(F.lit("for a term of "), (key % 9 + 1).cast("string"), F.lit(" years")),
    )
    return c.select("c_custkey", text.alias("text"))


def discharges(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    day = lambda d: F.date_format(F.date_add(F.to_date("o_orderdate"), d), "yyyy-MM-dd")
    text = F.concat_ws(
        "\n",
        F.lit("DISCHARGE SUMMARY"), F.concat(F.lit("Hospital: Clinic "), (key % 17).cast("string")), F.lit("Patient Name: John Doe"),
        F.concat(F.lit("Admission Date: "), day(0)),
        F.concat(F.lit("Discharge Date: "), F.when(key % 6 == 0, day(-1)).otherwise(day(4))),
        F.concat(F.lit("Primary Diagnosis: Code "), (key % 31).cast("string")),
        F.when(key % 4 != 0, F.concat(F.lit("Medications:\n - Drug A "), (key % 10).cast("string"), F.lit("\n - Drug B"))),
    )
    return o.select("o_orderkey", text.alias("text"))
