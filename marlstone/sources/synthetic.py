"""Invented parties and contracts, the same for the same seed, made where they are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _share(seed: int, salt: str, *cols: str) -> Column:
    """A number from 0 to 1 that depends on the seed and the row's keys alone."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *cols), F.lit(1_000_000)) / 1_000_000


def parties(spark: SparkSession, n: int = 1000, seed: int = 42) -> DataFrame:
    """Versions of n parties: four fifths individuals, and for 18 in 100 a closed version before the active one."""
    ids = spark.range(1, n + 1).select(F.col("id").alias("party_id"))
    base = ids.withColumn("party_type", F.when(_share(seed, "type", "party_id") < 0.8, "INDIVIDUAL").otherwise("ORGANIZATION"))
    country = F.element_at(F.array(*[F.lit(c) for c in ("DE", "FR", "US", "GB", "KY", "PA")]), (F.floor(_share(seed, "country", "party_id") * 6) + 1).cast("int"))
    base = base.withColumn("country_code", country)
    risky = F.col("country_code").isin("KY", "PA") | (_share(seed, "aml", "party_id") < 0.05)
    base = base.withColumn("aml_risk_rating", F.when(risky, "HIGH").when(_share(seed, "medium", "party_id") < 0.3, "MEDIUM").otherwise("LOW"))
    former = _share(seed, "former", "party_id") < 0.18
    start, cut, end = (F.lit(x).cast("timestamp_ntz") for x in ("2020-01-01", "2023-01-01", "9999-12-31 23:59:59"))
    version = lambda a, b, on: F.struct(a.alias("valid_from"), b.alias("valid_to"), F.lit(on).alias("md_is_active"))
    rows = F.when(former, F.array(version(start, cut, False), version(cut, end, True))).otherwise(F.array(version(start, end, True)))
    return base.select("*", F.inline(rows))


def contracts(active: DataFrame, seed: int = 42) -> DataFrame:
    """One to five contracts of each active party: six in ten deposits, 8 in 100 without a balance, 10 in 100 loans not performing."""
    n = (F.floor(_share(seed, "contracts", "party_id") * 5) + 1).cast("int")
    each = active.where("md_is_active").select("party_id", F.explode(F.sequence(F.lit(1), n)).alias("number"))
    deposit = _share(seed, "deposit", "party_id", "number") < 0.6
    amount = F.round(_share(seed, "amount", "party_id", "number") * 100_000, 2).cast("decimal(18,4)")
    empty, bad = _share(seed, "empty", "party_id", "number") < 0.08, _share(seed, "npl", "party_id", "number") < 0.10
    return each.select("party_id", "number", F.when(deposit, "DEPOSIT").otherwise("LOAN").alias("kind"), F.when(deposit & empty, -amount).otherwise(amount).alias("amount"), (~deposit & bad).alias("is_npl"))


def seed(spark: SparkSession, folder: str, n: int = 1000, seed: int = 42) -> None:
    """Write both tables; writing them again replaces them."""
    p = parties(spark, n, seed)
    p.write.mode("overwrite").parquet(f"{folder}/parties")
    contracts(p, seed).write.mode("overwrite").parquet(f"{folder}/contracts")
