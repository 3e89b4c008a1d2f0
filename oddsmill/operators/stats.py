
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.prices import clip_probability, logit, momentum, wilson_interval
from .calibration import FAVOURITE, LONGSHOT, brier
from .series import price_at_horizons, temporal_split

Z = 1.959963984540054


def pointwise_log_loss(y: Column, p: Column) -> Column:
    """[A30]"""
    q = clip_probability(p)
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def log_loss(y: Column, p: Column) -> Column:
    """[A30] An aggregate; null without rows."""
    return F.avg(pointwise_log_loss(y, p))


def paired_loss(rows: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """[A31] Mean difference of the losses of forecasts a and b, its standard error and t; t is null without spread."""
    d = pointwise_log_loss(F.col("y"), F.col(a)) - pointwise_log_loss(F.col("y"), F.col(b))
    out = rows.withColumn("_d", d).groupBy(*keys).agg(F.avg("_d").alias("mean_difference"), (F.stddev_samp("_d") / F.sqrt(F.count("_d"))).alias("std_error"), F.count("_d").alias("n"))
    return out.where("n >= 2").withColumn("t_stat", F.when(F.col("std_error") > 0, F.try_divide(F.col("mean_difference"), F.col("std_error"))))


def naive_interval(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """[A32] Mean and its normal interval as if rows were independent; bounds are null for one row."""
    half = Z * F.stddev_samp(value) / F.sqrt(F.count(value))
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"), (F.avg(value) - half).alias("low"), (F.avg(value) + half).alias("high"))


def hash_index(text: Column, n: Column) -> Column:
    """A number in [0, n) from the first 32 bits of the MD5 of a text; SQL engines agree on it."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") % n


def cluster_bootstrap(rows: DataFrame, value: str, cluster: str, *keys: str, n_boot: int = 800, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """[X1] Mean, and the percentile interval of means over resampled whole clusters.

    Clusters are reduced to (sum, n) first. Each replicate draws as many clusters as there are, by a hash of (seed, replicate, draw); the draws
    are joined to the numbered clusters by that number and added up per replicate, so the rows are n_boot times the clusters of a key and
    nothing is collected.
    """
    keys = list(keys)
    sums = rows.where(F.col(value).isNotNull()).groupBy(*keys, cluster).agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    total = sums.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("_n").alias("n_obs"), (F.sum("_sum") / F.sum("_n")).alias("mean"))
    # a cluster's number is its rank by id in its key
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy(cluster) if keys else Window.orderBy(cluster)
    numbered = sums.withColumn("_at", (F.row_number().over(order) - 1).cast("bigint"))
    draws = total.select(*keys, "n_clusters", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("rep"))
    draws = draws.select(*keys, "rep", "n_clusters", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_clusters") - 1)).alias("draw"))
    name = F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("draw").cast("string"))
    drawn = draws.withColumn("_at", hash_index(name, F.col("n_clusters")))
    means = drawn.join(numbered, [*keys, "_at"]).groupBy(*keys, "rep").agg((F.sum("_sum") / F.sum("_n")).alias("m"))
    bounds = means.groupBy(*keys).agg(F.percentile("m", alpha / 2).alias("low"), F.percentile("m", 1 - alpha / 2).alias("high"))
    return total.join(bounds, keys) if keys else total.crossJoin(F.broadcast(bounds))


def design_effect(rows: DataFrame, value: str, cluster: str, *keys: str, **options) -> DataFrame:
    """[X2, X3] Width of the clustered interval over the naive one (null if that has none), and the sample size it leaves."""
    whole = cluster_bootstrap(rows, value, cluster, *keys, **options)
    naive = naive_interval(rows, value, *keys).select(*keys, (F.col("high") - F.col("low")).alias("_width"))
    out = whole.join(naive, list(keys)) if keys else whole.crossJoin(F.broadcast(naive))
    deff = F.when(F.col("_width") > 0, F.try_divide(F.col("high") - F.col("low"), F.col("_width")))
    return out.withColumn("design_effect", deff).withColumn("effective_n", F.try_divide(F.col("n_obs"), F.col("design_effect") * F.col("design_effect"))).drop("_width")


def robustness(rows: DataFrame, least: int = 30, n_boot: int = 800) -> DataFrame:
    """[X4] Per platform and segment (below 0.1, above 0.9) of rows(platform, cluster, p, y): does the implied price lie outside the interval of
    the actual rate, by Wilson and by resampled clusters?"""
    segment = F.when(F.col("p") < LONGSHOT, "longshot").when(F.col("p") > FAVOURITE, "favourite")
    parts = rows.withColumn("segment", segment).where("segment is not null")
    keys = ["platform", "segment"]
    total = parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("implied"), F.sum("y").alias("hits")).where(F.col("n") >= least)
    low, high = wilson_interval(F.col("hits"), F.col("n"))
    naive = total.select(*keys, "implied", low.alias("wilson_low"), high.alias("wilson_high"))
    whole = cluster_bootstrap(parts.join(naive.select(*keys), keys, "left_semi"), "y", "cluster", *keys, n_boot=n_boot)
    outside = lambda a, b: ~F.col("implied").between(F.col(a), F.col(b))
    out = whole.join(naive, keys).withColumns({"naive_significant": outside("wilson_low", "wilson_high"), "clustered_significant": outside("low", "high")})
    verdict = F.when(F.col("naive_significant") & F.col("clustered_significant"), "significant both ways").when(F.col("naive_significant"), "lost under clustering").otherwise("not significant either way")
    return out.withColumn("verdict", verdict)


def feature_frame(prices: DataFrame, markets: DataFrame, now: int = 86_400, before: int = 8 * 86_400) -> DataFrame:
    """[A33, W6] One row per market with a price a day before close: what is known then, and the outcome.

    markets(platform, market_id, anchor, outcome, bucket, volume). Lifetime counts from the first usable price; a later row never changes a feature.
    """
    at = price_at_horizons(prices, markets, {"now": now, "before": before})
    wide = at.groupBy("platform", "market_id").pivot("horizon", ["now", "before"]).agg(F.first("snapshot")).where("now is not null")
    first = prices.groupBy("platform", "market_id").agg(F.min("ts").alias("_first"))
    out = wide.join(markets, ["platform", "market_id"]).join(first, ["platform", "market_id"])
    return out.select(
        "platform",
        "market_id",
        "bucket",
        "anchor",
        F.col("now").alias("p_now"),
        logit(F.col("now")).alias("logit_now"),
        momentum(F.col("now"), F.col("before")).alias("momentum"),
        F.col("before").isNotNull().cast("double").alias("has_momentum"),
        ((F.col("anchor") - F.col("_first")) / 86_400.0).alias("lifetime_days"),
        F.log1p(F.coalesce("volume", F.lit(0.0))).alias("log_volume"),
        (F.col("outcome") == "YES").cast("double").alias("y"),
    )


def design_columns(train: DataFrame, rows: DataFrame, columns: tuple[str, ...] = ("bucket", "platform")) -> tuple[DataFrame, list[str]]:
    """[X5] rows with 0/1 columns for all categories of train but the alphabetically first. Each is a column of the model, so they are read once, by the driver."""
    added = {}
    for c in columns:
        known = sorted(r[0] for r in train.select(c).where(F.col(c).isNotNull()).distinct().collect())
        added |= {f"{c}_{value}": F.coalesce((F.col(c) == value).cast("double"), F.lit(0.0)) for value in known[1:]}
    return rows.withColumns(added) if added else rows, list(added)


def logistic(train: DataFrame, test: DataFrame, columns: list[str], c: float = 1.0) -> DataFrame:
    """[X6] test with column ``prob`` of an L2 logistic regression; the penalty is averaged over rows as Spark's objective is.

    The probability is an expression of the coefficients. (The model's own transformer holds the session, which can't be sent to tasks once it has observed metrics.)
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    gather = VectorAssembler(inputCols=columns, outputCol="_x")
    n = train.count()
    model = LogisticRegression(featuresCol="_x", labelCol="y", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=2000, predictionCol="_hat").fit(gather.transform(train))
    z = F.lit(float(model.intercept))
    for name, weight in zip(columns, model.coefficients.toArray().tolist()):
        z = z + F.lit(weight) * F.col(name)
    return test.withColumn("prob", 1 / (1 + F.exp(-z)))


def model_comparison(features: DataFrame, test_fraction: float = 0.3, least_train: int = 500, least_test: int = 200) -> DataFrame:
    """[X7] Log loss and Brier score on later markets: the price, the price recalibrated, all features, and the base rate; with the gains over the price and over the recalibrated price."""
    split = temporal_split(features.withColumn("_when", F.timestamp_seconds("anchor")), "_when", test_fraction).cache()
    train, test = split.where("not is_test"), split.where("is_test")
    n_train, n_test = train.count(), test.count()
    if n_train < least_train or n_test < least_test:
        raise ValueError(f"{n_train} rows to train and {n_test} to test are too few")
    recalibrated = logistic(train, test, ["logit_now"]).withColumnRenamed("prob", "p_recalibrated")
    wide, names = design_columns(train, recalibrated)
    full = logistic(design_columns(train, train)[0], wide, ["logit_now", "momentum", "has_momentum", "lifetime_days", *names]).withColumnRenamed("prob", "p_full")
    base = test.agg(F.avg("y").alias("p_base"))
    scored = full.crossJoin(F.broadcast(base))
    views = F.explode(F.array(*(F.struct(F.lit(k).alias("model"), F.col(c).alias("p")) for k, c in (("price", "p_now"), ("recalibrated", "p_recalibrated"), ("full", "p_full"), ("base_rate", "p_base")))))
    long = scored.select("y", "p_now", "p_recalibrated", views.alias("v")).select("y", "p_now", "p_recalibrated", "v.*")
    loss = long.groupBy("model").agg(log_loss(F.col("y"), F.col("p")).alias("log_loss"), brier(F.col("p"), F.col("y")).alias("brier"))
    gain = paired_loss(long, "p_now", "p", "model").select("model", F.col("mean_difference").alias("gain"), "std_error", "t_stat", "n")
    beyond = paired_loss(long, "p_recalibrated", "p", "model").select("model", F.col("mean_difference").alias("gain_over_recalibrated"), F.col("t_stat").alias("t_over_recalibrated"))
    return loss.join(gain, "model").join(beyond, "model")


def wilson(hits: int, n: int, z: float = 1.96) -> tuple[float, float]:
    """[2.12] The interval for plain numbers, as reports print it."""
    if not n:
        return 0.0, 1.0
    share, scale = hits / n, z * z / n
    centre, half = (share + scale / 2) / (1 + scale), z * math.sqrt(share * (1 - share) / n + scale / (4 * n)) / (1 + scale)
    return max(0.0, centre - half), min(1.0, centre + half)
