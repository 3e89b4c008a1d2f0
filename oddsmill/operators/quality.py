"""

One grouped pass over all platforms takes the place of one statement per platform.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.prices import coverage_ratio, lifetime_hours, percent

MIN_HOURS = 24.0
#: Sub-day markets are counted against this, whatever the headline threshold is.
SHORT_HOURS = 24.0


def headline_markets(markets: DataFrame, min_hours: float = MIN_HOURS) -> DataFrame:
    """Resolved markets with both times that lived at least so long, with lifetime_hours."""
    out = markets.withColumn("lifetime_hours", lifetime_hours(F.col("open_ts"), F.col("close_ts")))
    return out.where(F.col("outcome").isin("YES", "NO") & F.col("open_ts").isNotNull() & F.col("close_ts").isNotNull() & (F.col("lifetime_hours") >= min_hours))


def market_counts(markets: DataFrame, min_hours: float = MIN_HOURS) -> DataFrame:
    """[A3] total, headline, no_outcome, excluded_short per platform."""
    hours = lifetime_hours(F.col("open_ts"), F.col("close_ts"))
    known = F.col("outcome").isin("YES", "NO")
    return markets.groupBy("platform").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(known & (hours >= min_hours)).alias("headline"),
        F.count_if(F.col("outcome").isNull()).alias("no_outcome"),
        F.count_if(known & (hours < SHORT_HOURS)).alias("excluded_short"),
    )


def date_coverage(markets: DataFrame) -> DataFrame:
    """[A4] First and last close per platform."""
    return markets.groupBy("platform").agg(F.min("close_ts").alias("first_close"), F.max("close_ts").alias("last_close"))


def outcome_distribution(markets: DataFrame) -> DataFrame:
    """[A5]"""
    return markets.groupBy("platform", "outcome").agg(F.count(F.lit(1)).alias("n"))


def top_categories(markets: DataFrame, limit: int = 15) -> DataFrame:
    """[A6, T1] The most frequent categories of each platform, ties by name."""
    counts = markets.groupBy("platform", F.coalesce("category", F.lit("(none)")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("platform").orderBy(F.col("n").desc(), "category")
    return counts.withColumn("at", F.row_number().over(order)).where(F.col("at") <= limit)


def price_stats(prices: DataFrame, markets: DataFrame) -> DataFrame:
    """[A7, J1] Per platform: rows, markets, rows without price, their percentage, and mean coverage of the life (none counts as 0) of known markets."""
    per = prices.groupBy("platform", "market_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("price").isNull()).alias("missing"))
    days = (F.unix_timestamp("close_ts") - F.unix_timestamp("open_ts")) / 86_400.0
    joined = per.join(markets.select("platform", "market_id", F.coalesce(days, F.lit(0.0)).alias("life")), ["platform", "market_id"], "left")
    out = joined.groupBy("platform").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("markets"), F.sum("missing").alias("missing"), F.avg(F.when(F.col("life").isNotNull(), coverage_ratio(F.col("n"), F.col("life")))).alias("mean_coverage"))
    return out.withColumn("pct_missing", percent(F.col("missing"), F.col("n_rows")))


def base_rates(headline: DataFrame) -> DataFrame:
    """[A1]"""
    yes = F.col("outcome") == "YES"
    return headline.groupBy("platform").agg(F.count(F.lit(1)).alias("markets"), F.count_if(yes).alias("yes_count"), F.avg(yes.cast("double")).alias("yes_share"))


def monthly_counts(headline: DataFrame) -> DataFrame:
    """[A2, W1] Markets per closing month, with the running total."""
    months = headline.groupBy("platform", F.date_format("close_ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("markets"))
    return months.withColumn("cumulative", F.sum("markets").over(Window.partitionBy("platform").orderBy("month")))


def category_shares(headline: DataFrame) -> DataFrame:
    """[W2] Markets per category and their percentage of the platform."""
    counts = headline.groupBy("platform", F.coalesce("category", F.lit("(none)")).alias("category")).agg(F.count(F.lit(1)).alias("markets"))
    return counts.withColumn("pct_of_platform", 100.0 * F.col("markets") / F.sum("markets").over(Window.partitionBy("platform")))


def coverage_per_market(prices: DataFrame, markets: DataFrame) -> DataFrame:
    """[A8] Price rows against days of life, for every market with prices."""
    per = prices.groupBy("platform", "market_id").agg(F.count("ts").alias("price_days"))
    life = (F.unix_timestamp("close_ts") - F.unix_timestamp("open_ts")) / 86_400.0
    out = per.join(markets.select("platform", "market_id", life.alias("lifetime_days")), ["platform", "market_id"])
    return out.withColumn("coverage", F.least(F.lit(1.0), F.col("price_days") / F.greatest("lifetime_days", F.lit(1.0))))


def last_price_calibration(prices: DataFrame, headline: DataFrame) -> DataFrame:
    """[J2, W3, F3] Rate of YES per tenth of the last price before close."""
    prob = F.coalesce("price", (F.col("bid") + F.col("ask")) / 2)
    last = prices.groupBy("platform", "market_id").agg(F.max(F.struct("ts", prob.alias("prob"))).alias("last")).select("platform", "market_id", F.col("last.prob").alias("prob"))
    joined = headline.select("platform", "market_id", "outcome").join(last, ["platform", "market_id"]).where("prob is not null")
    bucket = F.floor(F.col("prob") * 10 + 0.5) / 10
    return joined.groupBy("platform", bucket.alias("price_bucket")).agg(F.count(F.lit(1)).alias("markets"), F.avg((F.col("outcome") == "YES").cast("double")).alias("empirical_yes_rate"))


def volume_terciles(headline: DataFrame) -> DataFrame:
    """[W4] NTILE(3) of volume within the platform, ties by id; markets without volume are left out."""
    order = Window.partitionBy("platform").orderBy("volume", "market_id")
    return headline.where("volume is not null").select("platform", F.ntile(3).over(order).alias("volume_tercile"), "market_id", "volume")
