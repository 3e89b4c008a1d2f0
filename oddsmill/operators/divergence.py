
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PAIR = ("pm_id", "k_id")
POINTS = 100.0


def align_pairs(pairs: DataFrame, pm: DataFrame, k: DataFrame) -> DataFrame:
    """[J3, J7, F5] pm_id, k_id, day, pm, k, spread on the days that both have a price.

    pairs(pm_id, k_id, orientation); pm and k (market_id, day, price). An inverse pair flips the second series.
    """
    one = pm.select(F.col("market_id").alias("pm_id"), "day", F.col("price").alias("pm"))
    two = k.select(F.col("market_id").alias("k_id"), "day", F.col("price").alias("k"))
    out = pairs.select(*PAIR, "orientation").join(one, "pm_id").join(two, ["k_id", "day"])
    out = out.where("pm is not null and k is not null").withColumn("k", F.when(F.col("orientation") == "inverse", 1 - F.col("k")).otherwise(F.col("k")))
    return out.select(*PAIR, "day", "pm", "k", ((F.col("pm") - F.col("k")) * POINTS).alias("spread"))


def spread_stats(aligned: DataFrame, *keys: str) -> DataFrame:
    """[A17] n_days, mean_abs, max_abs and the shares of days beyond 2, 5 and 10 points."""
    gap = F.abs("spread")
    over = [(F.avg((gap > x).cast("double")) * 100).alias(f"pct_gt{x}") for x in (2, 5, 10)]
    return aligned.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_days"), F.avg(gap).alias("mean_abs"), F.max(gap).alias("max_abs"), *over)


def half_lives(gaps: Column, threshold: float = 5.0) -> Column:
    """[W9] Rows from the peak of each event to the first gap of at most half the peak; gaps is an ordered array of absolute spreads.

    An event opens when a gap reaches the threshold from below (or at the start), moves to every wider gap before it
    halves, and isn't counted if it never does.
    """
    state = F.struct(F.lit(0).alias("i"), F.lit(False).alias("on"), F.lit(0.0).alias("peak"), F.lit(0).alias("at"), F.lit(0.0).alias("before"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, gap: Column) -> Column:
        opens = ~s["on"] & (gap >= threshold) & ((s["i"] == 0) | (s["before"] < threshold))
        halves = s["on"] & (gap <= s["peak"] / 2)
        widens = s["on"] & ~halves & (gap >= threshold) & (gap > s["peak"])
        moves = opens | widens
        return F.struct(
            (s["i"] + 1).alias("i"),
            (opens | (s["on"] & ~halves)).alias("on"),
            F.when(moves, gap).otherwise(s["peak"]).alias("peak"),
            F.when(moves, s["i"]).otherwise(s["at"]).alias("at"),
            gap.alias("before"),
            F.when(halves, F.concat(s["out"], F.array((s["i"] - s["at"]).cast("double")))).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(gaps, state, step, lambda s: s["out"])


def pair_table(aligned: DataFrame, threshold: float = 5.0, least_days: int = 2) -> DataFrame:
    """[A18] The statistics of each pair with its half-lives; a pair needs some common days."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("day", F.abs("spread").alias("gap")))), lambda x: x["gap"])
    events = aligned.groupBy(*PAIR).agg(ordered.alias("gaps")).select(*PAIR, half_lives(F.col("gaps"), threshold).alias("half_lives"))
    return spread_stats(aligned, *PAIR).where(F.col("n_days") >= least_days).join(events, list(PAIR))


def divergence_summary(table: DataFrame) -> DataFrame:
    """[A19] Over all pairs: means weighted by days, and the median and upper quartile of all half-lives."""
    days = F.sum("n_days")
    means = [(F.sum(F.col(c) * F.col("n_days")) / days).alias(c) for c in ("mean_abs", "pct_gt2", "pct_gt5", "pct_gt10")]
    spread = table.agg(F.count(F.lit(1)).alias("pairs"), days.alias("pair_days"), *means)
    events = table.select(F.explode("half_lives").alias("h")).agg(F.count(F.lit(1)).alias("events"), F.percentile("h", 0.5).alias("half_life_median"), F.percentile("h", 0.75).alias("half_life_p75"))
    return spread.crossJoin(F.broadcast(events))


def lead_lag(aligned: DataFrame, max_lag: int = 2, least_days: int = 0) -> DataFrame:
    """[W10] pm_id, k_id, lag, corr of daily changes; a positive lag is the first venue leading. Null for fewer than 3 pairs or no variance."""
    w = Window.partitionBy(*PAIR).orderBy("day")
    moves = aligned.withColumns({"dp": F.col("pm") - F.lag("pm").over(w), "dk": F.col("k") - F.lag("k").over(w), "_days": F.count(F.lit(1)).over(Window.partitionBy(*PAIR))})
    shifted = [F.struct(F.lit(k).alias("lag"), (F.lead("dk", k) if k >= 0 else F.lag("dk", -k)).over(w).alias("dk")) for k in range(-max_lag, max_lag + 1)]
    long = moves.withColumn("_s", F.array(*shifted)).select(*PAIR, "_days", "dp", F.explode("_s").alias("s"))
    long = long.where(F.col("_days") >= least_days).select(*PAIR, F.col("s.lag").alias("lag"), F.when(F.col("s.dk").isNotNull(), F.col("dp")).alias("x"), F.when(F.col("dp").isNotNull(), F.col("s.dk")).alias("y"))
    out = long.groupBy(*PAIR, "lag").agg(F.count("x").alias("n"), F.covar_pop("x", "y").alias("cov"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    flat = (F.col("n") < 3) | (F.col("sx") < 1e-12) | (F.col("sy") < 1e-12)
    return out.select(*PAIR, "lag", F.when(~flat, F.try_divide(F.col("cov"), F.col("sx") * F.col("sy"))).alias("corr"))


def lead_lag_summary(aligned: DataFrame, max_lag: int = 2, least_days: int = 20) -> DataFrame:
    """[A20] Mean correlation per lag over the pairs with enough common days; undefined ones are skipped."""
    return lead_lag(aligned, max_lag, least_days).groupBy("lag").agg(F.avg("corr").alias("mean_corr"), F.count("corr").alias("pairs"))


def case_rules(least_days: int = 30, long_days: int = 100) -> tuple[tuple[str, str, str], ...]:
    """[T5] Rules in order: a name, a predicate over pairs with enough days, and the column to sort by, descending."""
    rules = (
        ("calm_then_violent", f"n_days >= {long_days} and max_abs >= 25", "n_days"),
        ("one_large_gap", "max_abs >= 40 and mean_abs <= 4", "max_abs"),
        ("persistent_offset", "mean_abs >= 3 and mean_abs / case when max_abs = 0 then 1 else max_abs end >= 0.5", "mean_abs"),
        ("basis_risk", "basis_risk", "n_days"),
        ("typical", "mean_abs <= 1.0", "n_days"),
    )
    return tuple((name, f"n_days >= {least_days} and {p}", column) for name, p, column in rules)


def case_studies(table: DataFrame, cases: tuple[tuple[str, str, str], ...] | None = None) -> DataFrame:
    """[T5] case_name, pm_id, k_id: rule by rule, the best pair of table (the pair table with basis_risk) that no rule before took.

    As many candidates per rule as there are rules always hold the answer; these few are folded in one row.
    """
    cases = cases or case_rules()
    marks = F.array_compact(F.array(*(F.when(F.expr(p), F.struct(F.lit(i).alias("rule"), F.lit(name).alias("case_name"), F.col(c).cast("double").alias("value"))) for i, (name, p, c) in enumerate(cases))))
    rows = table.select(*PAIR, F.explode(marks).alias("m")).select(*PAIR, "m.*")
    order = Window.partitionBy("rule").orderBy(F.col("value").desc(), *PAIR)
    few = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= len(cases))
    item = F.struct("rule", "place", "case_name", *PAIR)
    kind = "array<struct<rule:int,place:int,case_name:string,pm_id:string,k_id:string>>"

    def take(taken: Column, x: Column) -> Column:
        used = F.exists(taken, lambda t: (t["rule"] == x["rule"]) | ((t["pm_id"] == x["pm_id"]) & (t["k_id"] == x["k_id"])))
        return F.when(used, taken).otherwise(F.concat(taken, F.array(x)))

    chosen = few.agg(F.array_sort(F.collect_list(item)).cast(kind).alias("items")).select(F.explode(F.aggregate("items", F.array().cast(kind), take)).alias("x"))
    return chosen.select("x.case_name", "x.pm_id", "x.k_id")


def histogram(aligned: DataFrame, bins: int = 40, low: float = -100.0, high: float = 100.0) -> DataFrame:
    """[D10] bin, n of the spreads: the data of a histogram figure."""
    width = (high - low) / bins
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("spread") - low) / width).cast("int")))
    return aligned.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
