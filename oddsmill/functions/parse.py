
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PM_MARKET = (
    "id string, question string, startDate string, createdAt string, endDate string, closedTime string, outcomes string, outcomePrices string, clobTokenIds string, "
    "umaResolutionStatus string, volumeNum double, liquidityNum double, category string, slug string, description string, tags array<struct<label:string>>, "
    "events array<struct<id:string,ticker:string,slug:string,title:string,negRisk:boolean,seriesSlug:string>>"
)
K_MARKET = (
    "ticker string, event_ticker string, title string, yes_sub_title string, rules_primary string, market_type string, result string, status string, open_time string, "
    "close_time string, settlement_ts string, expiration_time string, volume_fp string, liquidity_dollars string, volume double, liquidity double"
)
PM_HISTORY = "history array<struct<t:bigint,p:double>>"
_SIDE = "struct<open_dollars:string,high_dollars:string,low_dollars:string,close_dollars:string>"
K_CANDLES = f"ticker string, candlesticks array<struct<end_period_ts:bigint,volume_fp:string,price:{_SIDE},yes_bid:{_SIDE},yes_ask:{_SIDE}>>"
ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def normalize_iso(text: Column) -> Column:
    """[P1] Any of the venues' spellings as ``YYYY-MM-DDTHH:MM:SSZ``; without zone is UTC; rubbish is null."""
    return F.date_format(F.try_to_timestamp(F.nullif(F.trim(text), F.lit(""))), ISO)


def json_list(text: Column) -> Column:
    """[P2] A list held as JSON text; anything else is empty."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def proposition_leg(outcomes: Column) -> Column:
    """[P3] Index of ``yes`` among two outcomes, else 0; null unless there are two."""
    at = F.array_position(F.transform(outcomes, lambda x: F.lower(F.trim(x))), "yes").cast("int")
    return F.when(F.size(outcomes) == 2, F.greatest(at - 1, F.lit(0)))


def pm_outcome(outcomes: Column, prices: Column, status: Column) -> Column:
    """[P4] YES for a leg price of exactly 1, NO for 0, null otherwise or while the resolution is disputed."""
    price = F.get(prices, proposition_leg(outcomes)).try_cast("double")
    open_ = status.isNull() | (status == "resolved")
    return F.when((F.size(prices) == 2) & open_ & (price == 1.0), "YES").when((F.size(prices) == 2) & open_ & (price == 0.0), "NO")


def leg_token(tokens: Column, outcomes: Column) -> Column:
    """[P5]"""
    return F.get(tokens, proposition_leg(outcomes))


def pm_category(category: Column, tags: Column) -> Column:
    """[P6] The explicit category, else the first tag with a label."""
    labels = F.filter(F.transform(tags, lambda t: t["label"]), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.nullif(category, F.lit("")), F.get(labels, F.lit(0)))


def trimmed_events(events: Column) -> Column:
    """[P7] Nested events with the keys that later steps read."""
    return F.transform(events, lambda e: F.struct(*(e[k].alias(k) for k in ("id", "ticker", "slug", "title", "negRisk", "seriesSlug"))))


def pm_markets(raw: DataFrame) -> DataFrame:
    """[P8] Markets of the venue without books, from records of PM_MARKET."""
    outcomes, prices = json_list(F.col("outcomes")), json_list(F.col("outcomePrices"))
    return raw.select(
        F.lit("pm").alias("platform"),
        F.col("id").alias("market_id"),
        F.col("question").alias("title"),
        pm_category(F.col("category"), F.col("tags")).alias("category"),
        normalize_iso(F.coalesce("startDate", "createdAt")).alias("open_ts"),
        normalize_iso(F.coalesce("closedTime", "endDate")).alias("close_ts"),
        normalize_iso(F.col("closedTime")).alias("resolve_ts"),
        pm_outcome(outcomes, prices, F.col("umaResolutionStatus")).alias("outcome"),
        F.col("volumeNum").alias("volume"),
        F.col("liquidityNum").alias("liquidity"),
        leg_token(json_list(F.col("clobTokenIds")), outcomes).alias("token"),
        F.to_json(F.struct(F.col("id"), F.col("slug"), F.col("description"), trimmed_events(F.col("events")).alias("events"), F.transform("tags", lambda t: t["label"]).alias("tags"))).alias("raw_json"),
    )


def pm_prices(raw: DataFrame, market_id: Column) -> DataFrame:
    """[P9] Points of a price history; a point without time or price is skipped."""
    points = raw.select(market_id.alias("market_id"), F.explode("history").alias("x")).where("x.t is not null and x.p is not null")
    null = F.lit(None).cast("double")
    return points.select(F.lit("pm").alias("platform"), "market_id", F.col("x.t").alias("ts"), F.col("x.p").alias("price"), null.alias("bid"), null.alias("ask"), null.alias("volume"))


def dollars(text: Column) -> Column:
    """[P10] A dollar string as a number; empty or rubbish is null."""
    return F.nullif(F.trim(text), F.lit("")).try_cast("double")


def k_markets(raw: DataFrame) -> DataFrame:
    """[P11] Binary markets of the venue with books, from records of K_MARKET."""
    return raw.where("market_type = 'binary'").select(
        F.lit("k").alias("platform"),
        F.col("ticker").alias("market_id"),
        "title",
        series_of(F.col("event_ticker"), F.col("ticker")).alias("series"),
        normalize_iso(F.col("open_time")).alias("open_ts"),
        normalize_iso(F.col("close_time")).alias("close_ts"),
        normalize_iso(F.coalesce("settlement_ts", "expiration_time")).alias("resolve_ts"),
        F.when(F.col("result") == "yes", "YES").when(F.col("result") == "no", "NO").alias("outcome"),
        F.coalesce(dollars(F.col("volume_fp")), F.col("volume")).alias("volume"),
        F.coalesce(dollars(F.col("liquidity_dollars")), F.col("liquidity")).alias("liquidity"),
        F.to_json(F.struct("event_ticker", "yes_sub_title", "rules_primary")).alias("raw_json"),
    )


def k_prices(raw: DataFrame) -> DataFrame:
    """[P12] Candles as rows: the closing trade, if there was one, and the closing quotes."""
    c = raw.select(F.col("ticker").alias("market_id"), F.explode("candlesticks").alias("c")).where("c.end_period_ts is not null")
    return c.select(
        F.lit("k").alias("platform"),
        "market_id",
        F.col("c.end_period_ts").alias("ts"),
        dollars(F.col("c.price.close_dollars")).alias("price"),
        dollars(F.col("c.yes_bid.close_dollars")).alias("bid"),
        dollars(F.col("c.yes_ask.close_dollars")).alias("ask"),
        dollars(F.col("c.volume_fp")).alias("volume"),
    )


def keep_series(frequency: Column, category: Column, ticker: Column, frequencies=(), categories=(), prefixes=()) -> Column:
    """[P13] Not of a rejected frequency, category or ticker prefix; null values are kept."""
    bad = F.coalesce(frequency.isin(*frequencies), F.lit(False)) if frequencies else F.lit(False)
    if categories:
        bad = bad | F.coalesce(category.isin(*categories), F.lit(False))
    for prefix in prefixes:
        bad = bad | F.coalesce(ticker.startswith(prefix), F.lit(False))
    return ~bad


def series_of(event_ticker: Column, ticker: Column) -> Column:
    """[P14] What stands before the first dash."""
    return F.substring_index(F.coalesce(F.nullif(event_ticker, F.lit("")), ticker), "-", 1)


def cluster_id(platform: Column, raw_json: Column, market_id: Column) -> Column:
    """[P18] The event a market belongs to; a market without one stands alone."""
    event = F.when(platform == "pm", F.get_json_object(raw_json, "$.events[0].id")).otherwise(F.get_json_object(raw_json, "$.event_ticker"))
    return F.coalesce(F.nullif(event, F.lit("")), F.concat(F.lit("solo:"), market_id))


def content_key(url: Column, params: Column) -> Column:
    """[S4] Name of a cached response: a digest of its address and its parameters in order of their names."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), "&")
    return F.sha2(F.concat(url, F.lit("?"), pairs), 256)
