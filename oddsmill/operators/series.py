"""

All windows are partitioned by market, so their cost follows the longest single history, and several of
them share one shuffle and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

KEY = ("platform", "market_id")
PLACEHOLDER, NEAR, AGREE = 0.5, 0.015, 0.05


def daily_last(prices: DataFrame, *columns: str, key=KEY) -> DataFrame:
    """[W5] The last row of each market and UTC day; of equal times the greatest values."""
    day = F.to_date(F.timestamp_seconds("ts"))
    last = F.max(F.struct("ts", *columns))
    out = prices.groupBy(*key, day.alias("day")).agg(last.alias("last"))
    return out.select(*key, "day", *(F.col(f"last.{c}").alias(c) for c in columns))


def strip_placeholder(prices: DataFrame, platform: str | None = "pm") -> DataFrame:
    """[W6, W7] Without the prices that stand for no market yet.

    A leading run of exactly 0.5 goes. Then a price near 0.5 goes if it isn't near the nearest price on each side (those that there are)
    that is itself not near 0.5; with no such price it stays. Other platforms pass through.
    """
    w = Window.partitionBy(*KEY).orderBy("ts", "price")
    started = F.max(F.coalesce(F.col("price") != PLACEHOLDER, F.lit(False))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ours = F.lit(True) if platform is None else F.col("platform") == platform
    out = prices.withColumn("_ours", ours).withColumn("_started", started).where("_started or not _ours")
    near = F.abs(F.col("price") - PLACEHOLDER) <= NEAR
    far = F.when(~near, F.col("price"))
    before = F.last(far, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(far, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    out = out.withColumns({"_near": near, "_before": before, "_after": after})
    some = F.col("_before").isNotNull() | F.col("_after").isNotNull()
    apart = [F.coalesce(F.abs(F.col("price") - F.col(c)) > AGREE, F.lit(True)) for c in ("_before", "_after")]
    drop = F.col("_ours") & F.col("_near") & some & apart[0] & apart[1]
    return out.where(~F.coalesce(drop, F.lit(False))).select(*prices.columns)


def price_at_horizons(prices: DataFrame, markets: DataFrame, horizons: dict[str, int]) -> DataFrame:
    """[J10, J4] platform, market_id, horizon, snapshot: the last price at least so many seconds before close; markets without one are left out.

    markets needs anchor (seconds). Each price is kept once per horizon it precedes and aggregated map-side, so
    no history is collected.
    """
    marks = F.explode(F.array(*(F.struct(F.lit(k).alias("horizon"), F.lit(v).alias("back")) for k, v in horizons.items())))
    joined = prices.join(markets.select(*KEY, "anchor"), list(KEY)).select("*", marks.alias("h"))
    before = joined.where(F.col("ts") <= F.col("anchor") - F.col("h.back"))
    out = before.groupBy(*KEY, F.col("h.horizon").alias("horizon")).agg(F.max(F.struct("ts", "price")).alias("last"))
    return out.select(*KEY, "horizon", F.col("last.price").alias("snapshot"))


def latest_per_key(rows: DataFrame, *columns: str, key=KEY) -> DataFrame:
    """[W3] The last row per key by ts, then by the columns."""
    out = rows.groupBy(*key).agg(F.max(F.struct("ts", *columns)).alias("last"))
    return out.select(*key, "last.*")


def jump_guard(now: Column, before: Column, limit: float = 0.25) -> Column:
    """[W8] Whether a price moved no more than the limit since the row before; never for a first row."""
    return F.coalesce(F.abs(now - before) <= limit, F.lit(False))


def temporal_split(rows: DataFrame, column: str, test_fraction: float = 0.3) -> DataFrame:
    """[W12] rows with is_test: later than the interpolated quantile of the column (a timestamp)."""
    cut = rows.agg(F.percentile(F.unix_micros(column), 1 - test_fraction).alias("_cut"))
    return rows.crossJoin(F.broadcast(cut)).withColumn("is_test", F.unix_micros(column) > F.col("_cut")).drop("_cut")
