"""Aggregates: statistics, leaderboards, costs, page profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules


def tier_stats(log: DataFrame) -> DataFrame:
    return log.groupBy("tier").agg(F.count("*").alias("searches"), F.avg("passes").alias("avg_passes"), F.avg("results_count").alias("avg_results"), F.avg("latency_ms").alias("avg_latency_ms"), F.sum("results_count").alias("total_results")).orderBy("tier")


def domain_leaderboard(profiles: DataFrame, limit: int = 0) -> DataFrame:
    out = profiles.groupBy("domain").agg(F.count("*").alias("profile_count"), F.avg("success_rate").alias("avg_success_rate"), F.sum("total_uses").alias("total_uses"), F.sum("total_repairs").alias("total_repairs"), F.max("updated_at").alias("last_updated"))
    out = out.orderBy(F.desc("avg_success_rate"), F.desc("total_uses"), "domain")
    return out.limit(limit) if limit > 0 else out


def instance_leaderboard(reputation: DataFrame, limit: int = 50) -> DataFrame:
    return reputation.orderBy(F.desc("corrections_accepted"), "corrections_rejected", "instance_id").limit(limit)


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """what, rows of each table, counted side by side in one job."""
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("what"), "rows") for name, df in tables.items()))


def counts_by_shard(shards: DataFrame, tables: dict[str, DataFrame], key: str = "dossier_id") -> DataFrame:
    """Active shards with a count per table; 0 where a shard has no rows."""
    out = shards.where("status = 'active'").select(key, "name")
    for name, df in tables.items():
        out = out.join(df.groupBy(key).agg(F.count("*").alias(name)), key, "left")
    return out.select(key, "name", *(F.coalesce(n, F.lit(0)).alias(n) for n in tables))


def cheapest(pricing: DataFrame, dedicated: bool) -> DataFrame:
    return pricing.where((F.col("status") == "active") & (F.col("is_dedicated") == dedicated)).orderBy("cost_per_unit", "id").limit(1)


def cost_decision(pricing: DataFrame, backlog: float) -> DataFrame:
    """backlog_units, serverless_cost, dedicated_cost, decision for the active prices."""
    active = F.col("status") == "active"
    unit = F.min(F.when(active & ~F.col("is_dedicated"), F.col("cost_per_unit")))
    per_second = F.min_by(F.when(active & F.col("is_dedicated"), F.col("cost_per_sec")), F.when(active & F.col("is_dedicated"), F.struct("cost_per_unit", "id")))
    any_dedicated = F.coalesce(F.bool_or(active & F.col("is_dedicated")), F.lit(False))
    one = pricing.agg(unit.alias("u"), per_second.alias("s"), any_dedicated.alias("d"))
    return one.select(F.lit(backlog).alias("backlog_units"), rules.threshold_decision(F.lit(backlog), F.col("u"), F.col("s"), F.col("d")).alias("x")).select("backlog_units", "x.*")


def mutation_zones(mutations: DataFrame, seconds: float, static: tuple[str, ...] = ("nav", "header", "footer", "aside"), limit: float = 0.1) -> DataFrame:
    """Rate of mutations per page and selector, and which zones are dynamic; quiet landmarks are static."""
    out = mutations.groupBy("page_id", "selector").agg(F.count("*").alias("mutations")).withColumn("rate", F.col("mutations") / seconds)
    return out.withColumn("zone", F.when(F.col("rate") > limit, "dynamic").when(F.col("selector").isin(*static) & (F.col("mutations") == 0), "static").otherwise("mixed"))


def newest(df: DataFrame, key: str, time: str, tie: str, limit: int = 50) -> DataFrame:
    """The newest rows of each key, with their place."""
    w = Window.partitionBy(key).orderBy(F.desc(time), tie)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def latest(df: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """The newest row of each key, by an aggregate that combines before the shuffle."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(time, tie)).alias("x")).select("x.*")


def ranked(df: DataFrame, *order) -> DataFrame:
    """rows of one answer (a leaderboard that has its limit, not a table) with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def page(df: DataFrame, *order, limit: int = 20, offset: int = 0) -> DataFrame:
    out = df.orderBy(*order)
    return (out.offset(offset) if offset else out).limit(limit)


def first_of_passes(rows: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """The first occurrence of each key."""
    return rows.groupBy(key).agg(F.min(F.struct(*order, *(c for c in rows.columns if c not in (*order, key)))).alias("x")).select(key, "x.*")


def union_all(parts: list[DataFrame], tag: str | None = None, names: list[str] | None = None) -> DataFrame:
    """Rows of several shards, each with its name where tag is given."""
    if tag:
        parts = [p.withColumn(tag, F.lit(n)) for p, n in zip(parts, names or [], strict=True)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
