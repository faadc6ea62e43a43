"""The driver's tables in the roles of stays, events, intervals, codes and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardgrid.operators.timegrid import HOUR, micros

CONCEPTS = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 6)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("stay_id"), F.col("ts").cast("timestamp").alias("charttime"), F.col("event_type").alias("concept"), "value")


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stay per user, from the first event to the last."""
    span = events(spark, sf_dir).groupBy("stay_id").agg(F.min("charttime").alias("admit_time"), F.max("charttime").alias("discharge_time"))
    los = (micros("discharge_time") - micros("admit_time")) / F.lit(float(HOUR))
    return span.select((F.col("stay_id") % 100).alias("patient_id"), "stay_id", "admit_time", "discharge_time", los.alias("los_hours"), F.lit(None).cast("double").alias("weight"), (F.col("stay_id") % 7).alias("hospital_id"), (F.col("stay_id") % 5 == 0).alias("mortality_in_icu"))


def day_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumn("day", F.date_trunc("day", "charttime")).withColumn("stay_id", F.concat_ws("_", F.col("stay_id").cast("string"), F.date_format("day", "yyyy-MM-dd")))


def day_stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stay per user and day, from midnight to the last event; short ones, for the gates."""
    span = day_events(spark, sf_dir).groupBy("stay_id").agg(F.first("day").alias("admit_time"), F.max("charttime").alias("discharge_time"))
    los = (micros("discharge_time") - micros("admit_time")) / F.lit(float(HOUR))
    return span.select("stay_id", "admit_time", "discharge_time", los.alias("los_hours"), (F.split("stay_id", "_")[0].cast("double") % 60 + 10).alias("age"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases last value minutes, signups are open."""
    e = events(spark, sf_dir).where(F.col("concept").isin("purchase", "signup"))
    end = F.when(F.col("concept") == "purchase", F.timestamp_micros(micros("charttime") + (F.floor(F.col("value") * 60) * 1_000_000).cast("long")))
    return e.select("stay_id", F.col("charttime").alias("starttime"), end.alias("endtime"), F.col("concept").alias("drug"))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands of the parts of an order."""
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("stay_id"), F.col("p_brand").alias("code"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quality against a score with ties."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.round(F.least(F.col("n_chars") / 4000.0, F.lit(1.0)), 2).alias("score"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").alias("y"), "score", "toxic")


def order_stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stays of customers; label: the customer's lowest order has status F."""
    o = table(spark, sf_dir, "orders")
    first = o.groupBy("o_custkey").agg(F.min(F.struct("o_orderkey", "o_orderstatus"))["o_orderstatus"].alias("s"))
    return o.join(first, "o_custkey").select(F.col("o_custkey").alias("patient_id"), F.col("o_orderkey").alias("stay_id"), F.col("o_orderdate").cast("timestamp").alias("intime"), (F.col("s") == "F").cast("int").alias("label"))
