
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.prices import probability_bin, wilson_interval

LONGSHOT, FAVOURITE = 0.10, 0.90


def brier(p: Column, y: Column) -> Column:
    """[A9] Mean squared error, an aggregate; null without rows."""
    return F.avg(F.pow(p - y, F.lit(2)))


def _bins(rows: DataFrame, *keys: str, bins: int) -> DataFrame:
    out = rows.where("p is not null and y is not null").withColumn("bin", probability_bin(F.col("p"), bins))
    return out.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate"), F.sum("y").alias("hits"), F.sum(F.pow(F.col("p") - F.col("y"), F.lit(2))).alias("se")
    )


def murphy(rows: DataFrame, *keys: str, bins: int = 10, least: int = 1) -> DataFrame:
    """[A10, A13, A15] Per key: n, base_rate, brier, reliability, resolution, uncertainty, for keys of at least so many rows.

    Bins are aggregated first, so the second step sees at most ``bins`` rows per key.
    """
    binned = _bins(rows, *keys, bins=bins)
    total = binned.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.sum("se").alias("se"), F.collect_list(F.struct("n", "mean_p", "rate")).alias("parts"))
    total = total.where(F.col("n") >= least).withColumn("base_rate", F.col("hits") / F.col("n"))

    def weighted(term):
        return F.aggregate(F.array_sort("parts"), F.lit(0.0), lambda acc, x: acc + x["n"] * term(x)) / F.col("n")

    return total.select(
        *keys,
        "n",
        "base_rate",
        (F.col("se") / F.col("n")).alias("brier"),
        weighted(lambda x: F.pow(x["mean_p"] - x["rate"], F.lit(2))).alias("reliability"),
        weighted(lambda x: F.pow(x["rate"] - F.col("base_rate"), F.lit(2))).alias("resolution"),
        (F.col("base_rate") * (1 - F.col("base_rate"))).alias("uncertainty"),
    )


def calibration_table(rows: DataFrame, *keys: str, bins: int = 10) -> DataFrame:
    """[A11] Per key and bin that has rows: n, mean_p, yes_rate and its Wilson bounds."""
    out = _bins(rows, *keys, bins=bins)
    low, high = wilson_interval(F.col("hits"), F.col("n"))
    return out.select(*keys, (F.col("bin") / F.lit(float(bins))).alias("bin_low"), "n", "mean_p", F.col("rate").alias("yes_rate"), low.alias("ci_low"), high.alias("ci_high"))


def longshot_favourite(rows: DataFrame, *keys: str) -> DataFrame:
    """[A12] Per key and segment (below 0.1, above 0.9): n, mean_p, yes_rate, bounds."""
    segment = F.when(F.col("p") < LONGSHOT, "longshot").when(F.col("p") > FAVOURITE, "favourite")
    out = rows.withColumn("segment", segment).where("segment is not null").groupBy(*keys, "segment")
    out = out.agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("yes_rate"), F.sum("y").alias("hits"))
    low, high = wilson_interval(F.col("hits"), F.col("n"))
    return out.select(*keys, "segment", "n", "mean_p", "yes_rate", low.alias("ci_low"), high.alias("ci_high"))


def volume_tercile(rows: DataFrame, *keys: str) -> DataFrame:
    """[A14] rows with tercile 0, 1, 2 of volume within the key; no volume counts as 0, a value at a cut goes up."""
    volume = F.coalesce("volume", F.lit(0.0))
    cuts = rows.groupBy(*keys).agg(F.percentile(volume, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("_cuts"))
    tercile = F.when(volume < F.get("_cuts", F.lit(0)), 0).when(volume < F.get("_cuts", F.lit(1)), 1).otherwise(2)
    return rows.join(cuts, list(keys)).withColumn("tercile", tercile).drop("_cuts")


def paired_sharpening(snapshots: DataFrame, horizons: tuple[str, str], least: int = 100) -> DataFrame:
    """[A16, J11] The decomposition per platform and horizon on the markets that have both."""
    both = snapshots.where(F.col("horizon").isin(*horizons)).groupBy("platform", "market_id").agg(F.count(F.lit(1)).alias("_n")).where("_n = 2").select("platform", "market_id")
    return murphy(snapshots.where(F.col("horizon").isin(*horizons)).join(both, ["platform", "market_id"], "left_semi"), "platform", "horizon", least=least)
