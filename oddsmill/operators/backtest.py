
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.prices import taker_fee
from ..functions.titles import category_bucket, lookup
from .divergence import PAIR
from .series import jump_guard

# Taker fee rates.
PM_FEES = {"crypto": 0.07, "sports": 0.05, "econ": 0.04, "politics": 0.04, "science": 0.04, "mentions": 0.04, "entertainment": 0.05, "weather": 0.05, "other": 0.05}
K_FEE = 0.07


def pm_fee(category: Column) -> Column:
    """[B7] Fee rate of the first venue for one of its categories."""
    return lookup({k: str(v) for k, v in PM_FEES.items()}, category_bucket(F.lit("pm"), category), "0.05").cast("double")


def best_entry(pm: Column, k_ask: Column, k_bid: Column, fee: Column, slip: Column, k_fee: float = K_FEE) -> tuple[Column, Column]:
    """[B2] Direction and all-in cost of the cheaper way to hold both sides; slip (in points) worsens the first venue's price, up to 1."""
    yes = F.least(pm + slip / 100, F.lit(1.0))
    no = F.least(1 - pm + slip / 100, F.lit(1.0))
    rate = F.lit(k_fee)
    k_no = 1 - k_bid
    one = yes + taker_fee(fee, yes) + k_no + taker_fee(rate, k_no)
    two = k_ask + taker_fee(rate, k_ask) + no + taker_fee(fee, no)
    return F.when(one <= two, "pm_yes").otherwise("k_yes"), F.when(one <= two, one).otherwise(two)


def realized_payout(direction: Column, pm_outcome: Column, k_outcome: Column) -> Column:
    """[B3] Dollars that the two legs paid: 1 if both venues agreed."""
    one = (pm_outcome == "YES").cast("double") + (k_outcome == "NO").cast("double")
    two = (k_outcome == "YES").cast("double") + (pm_outcome == "NO").cast("double")
    return F.when(direction == "pm_yes", one).otherwise(two)


def tradable_days(pairs: DataFrame, pm: DataFrame, k_quotes: DataFrame) -> DataFrame:
    """[J8, F7] The days before the second venue's close day on which both venues quote.

    pairs(pm_id, k_id, orientation, verified, basis_risk, pm_outcome, k_outcome, category, resolve_day); pm(market_id, day, price);
    k_quotes(market_id, day, bid, ask). An inverse pair flips the first venue's price and outcome. Joins are by merge: from few columns Catalyst takes a
    side for small, and would broadcast a row for each market and day.
    """
    use = pairs.where("verified and not basis_risk and pm_outcome is not null and k_outcome is not null")
    inverse = F.col("orientation") == "inverse"
    outcome = F.when(inverse, F.when(F.col("pm_outcome") == "NO", "YES").otherwise("NO")).otherwise(F.col("pm_outcome"))
    one = pm.select(F.col("market_id").alias("pm_id"), "day", F.col("price").alias("pm"))
    two = k_quotes.where("bid is not null and ask is not null").select(F.col("market_id").alias("k_id"), "day", F.col("bid").alias("k_bid"), F.col("ask").alias("k_ask"))
    out = use.withColumn("pm_outcome", outcome).join(one.where("pm is not null").hint("merge"), "pm_id").join(two.hint("merge"), ["k_id", "day"]).where("day < resolve_day")
    return out.withColumn("pm", F.when(inverse, 1 - F.col("pm")).otherwise(F.col("pm")))


def run_backtest(days: DataFrame, slippage: tuple[float, ...] = (0.0, 1.0, 2.0, 3.0), edge_threshold: float = 0.0, k_fee: float = K_FEE) -> DataFrame:
    """[B4, B5, B6, W8, W11] The first qualifying entry of each pair, for every slippage at once.

    A day qualifies if the first venue's price did not jump since the day before (a first day never does) and the edge exceeds the threshold.
    """
    w = Window.partitionBy(*PAIR).orderBy("day")
    calm = days.withColumn("calm", jump_guard(F.col("pm"), F.lag("pm").over(w))).where("calm")
    swept = calm.withColumn("slippage", F.explode(F.array(*(F.lit(float(s)) for s in slippage))))
    direction, cost = best_entry(F.col("pm"), F.col("k_ask"), F.col("k_bid"), pm_fee(F.col("category")), F.col("slippage"), k_fee)
    held = F.greatest(F.datediff("resolve_day", "day"), F.lit(1))
    entry = F.struct("day", direction.alias("direction"), cost.alias("cost"), (1 - cost).alias("edge"), held.alias("days_held"), "pm_outcome", "k_outcome")
    found = swept.where(1 - cost > edge_threshold).groupBy(*PAIR, "slippage").agg(F.min(entry).alias("e")).select(*PAIR, "slippage", "e.*")
    payout = realized_payout(F.col("direction"), F.col("pm_outcome"), F.col("k_outcome"))
    # both sides may be free, with one quoted at 0 and the other at 1; then the yield has no bound
    gain = F.when(F.col("cost") == 0, F.lit(float("inf"))).otherwise(F.try_divide("edge", "cost"))
    return found.select(
        *PAIR,
        "slippage",
        F.col("day").alias("entry_day"),
        "direction",
        "cost",
        "edge",
        "days_held",
        (gain * 365 / F.col("days_held")).alias("annualized"),
        payout.alias("payout"),
        (payout - F.col("cost")).alias("pnl"),
    )


def backtest_summary(trades: DataFrame, days: DataFrame) -> DataFrame:
    """[A21] Per slippage: pairs that could trade, trades, edges, profits and exact-dollar payouts."""
    tradable = days.select(*PAIR).distinct().agg(F.count(F.lit(1)).alias("tradable_pairs"))
    out = trades.groupBy("slippage").agg(
        F.count(F.lit(1)).alias("opportunities"),
        F.avg("edge").alias("mean_edge"),
        F.median("edge").alias("median_edge"),
        F.sum("edge").alias("theoretical_pnl"),
        F.sum("pnl").alias("realized_pnl"),
        F.count_if(F.col("payout") == 1.0).alias("paying_exactly_1"),
        F.median("days_held").alias("median_days_held"),
        F.median("annualized").alias("median_annualized"),
    )
    return out.crossJoin(F.broadcast(tradable))
