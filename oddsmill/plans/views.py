"""The market data model over the benchmark tables: markets, prices, pairs and books as Spark views, and the same in DuckDB SQL.

``pm`` is the venue without books, ``k`` the one with bid and ask. Events are price rows of markets named by user; orders are markets with
outcomes and volume. Each view exists twice, written separately, so that the SQL twin checks it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.prices import usable_price
from ..operators import series
from ..sources.archive import table

HORIZONS = {"1h": 3_600, "24h": 86_400, "7d": 604_800}


def order_markets(spark: SparkSession, d: str) -> DataFrame:
    """Orders as markets: close is the last shipment, F is YES, O is NO, P is open."""
    shipped = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("closed"))
    o = table(spark, d, "orders").join(shipped, "o_orderkey", "left")
    return o.select(
        F.when(F.col("o_orderkey") % 2 == 0, "pm").otherwise("k").alias("platform"),
        F.col("o_orderkey").cast("string").alias("market_id"),
        F.when(F.col("o_orderkey") % 17 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("category"),
        F.col("o_orderdate").cast("timestamp").alias("open_ts"),
        F.col("closed").cast("timestamp").alias("close_ts"),
        F.when(F.col("o_orderstatus") == "F", "YES").when(F.col("o_orderstatus") == "O", "NO").alias("outcome"),
        F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice")).alias("volume"),
        F.col("o_custkey").alias("cluster"),
    )


def prices(spark: SparkSession, d: str) -> DataFrame:
    """Events as price rows: views and clicks on ``pm``, the rest on ``k`` with a quote; errors have a quote only."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("double") / 100
    half = (F.col("event_id") % 7) * 0.02
    low, high = F.greatest(k - half, F.lit(0.0)), F.least(k + half, F.lit(1.0))
    ours = F.col("event_type").isin("view", "click")
    crossed = F.col("event_id") % 50 == 0
    return e.select(
        F.when(ours, "pm").otherwise("k").alias("platform"),
        F.col("user_id").cast("string").alias("market_id"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"),
        F.when(F.col("event_type") != "error", k).alias("price"),
        F.when(~ours, F.when(crossed, high).otherwise(low)).alias("bid"),
        F.when(~ours, F.when(crossed, low).otherwise(high)).alias("ask"),
        F.col("value").alias("volume"),
    )


def usable(spark: SparkSession, d: str) -> DataFrame:
    """Price rows with the one usable price; rows without are left out."""
    p = prices(spark, d).withColumn("price", usable_price(F.col("price"), F.col("bid"), F.col("ask")))
    return p.where("price is not null").select("platform", "market_id", "ts", "price")


def clean(spark: SparkSession, d: str) -> DataFrame:
    return series.strip_placeholder(usable(spark, d))


CATEGORIES = ("Sports", "crypto", "Politics", "Weather", "unknown")


def event_markets(spark: SparkSession, d: str) -> DataFrame:
    """One market per venue and user: close half a day after the last event; outcomes agree on both venues except for every eleventh user."""
    e = table(spark, d, "events")
    venue = F.when(F.col("event_type").isin("view", "click"), "pm").otherwise("k")
    ts = F.unix_timestamp(F.col("ts").cast("timestamp"))
    m = e.groupBy(venue.alias("platform"), "user_id").agg(F.min(ts).alias("opened"), (F.max(ts) + 43_200).alias("anchor"), F.sum("value").alias("volume"))
    yes = (F.col("user_id") % 3 != 0) != ((F.col("platform") == "k") & (F.col("user_id") % 11 == 0))
    names = F.array(*(F.lit(c) for c in CATEGORIES))
    return m.select(
        "platform",
        F.col("user_id").cast("string").alias("market_id"),
        F.get(names, (F.col("user_id") % 5).cast("int")).alias("category"),
        "opened",
        "anchor",
        F.when(F.col("user_id") % 19 != 0, F.when(yes, "YES").otherwise("NO")).alias("outcome"),
        F.when(F.col("user_id") % 7 != 0, F.round("volume", 2)).alias("volume"),
        (F.col("user_id") % 20).alias("cluster"),
    )


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """platform, market_id, horizon, p, y, category, volume, cluster of resolved markets."""
    m = event_markets(spark, d).where("outcome is not null")
    at = series.price_at_horizons(clean(spark, d), m, HORIZONS)
    out = at.join(m.select("platform", "market_id", "category", "volume", "cluster", "outcome"), ["platform", "market_id"])
    return out.select("platform", "market_id", "horizon", F.col("snapshot").alias("p"), (F.col("outcome") == "YES").cast("double").alias("y"), "category", "volume", "cluster")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """One pair per user that both venues have, with orientation and verdicts."""
    m = event_markets(spark, d)
    one = m.where("platform = 'pm'").select("market_id", F.col("outcome").alias("pm_outcome"), "category")
    two = m.where("platform = 'k'").select("market_id", F.col("outcome").alias("k_outcome"), F.to_date(F.timestamp_seconds("anchor")).alias("resolve_day"))
    user = F.col("market_id").cast("long")
    return one.join(two.hint("merge"), "market_id").select(
        F.col("market_id").alias("pm_id"),
        F.col("market_id").alias("k_id"),
        F.when(user % 3 == 0, "inverse").otherwise("same").alias("orientation"),
        (user % 8 != 0).alias("verified"),
        (user % 10 == 0).alias("basis_risk"),
        "pm_outcome",
        "k_outcome",
        "category",
        "resolve_day",
    )


def daily(spark: SparkSession, d: str, venue: str) -> DataFrame:
    return series.daily_last(clean(spark, d).where(F.col("platform") == venue), "price")


def daily_quotes(spark: SparkSession, d: str) -> DataFrame:
    q = prices(spark, d).where("platform = 'k' and bid is not null and ask is not null")
    return series.daily_last(q, "bid", "ask")


def books(spark: SparkSession, d: str) -> DataFrame:
    """One book per supplier and venue from all line items, even order keys on ``pm``: odd line numbers bid, even ones offer. Each third supplier's book is thin."""
    li = table(spark, d, "lineitem").withColumn("disc", F.abs("l_discount"))
    step = F.round(F.col("disc") * 100).cast("int") * 3 + F.col("l_linenumber")
    bid = F.col("l_linenumber") % 2 == 1
    price = F.when(bid, (48 - step) / 100.0).otherwise((52 + step) / 100.0)
    size = F.col("l_quantity") / F.when(F.col("l_suppkey") % 3 == 0, 8.0).otherwise(1.0)
    side = lambda c: F.array_sort(F.collect_list(F.when(c, F.struct(F.when(bid, -price).otherwise(price).alias("o"), size.alias("size")))))
    g = li.groupBy(
        F.when(F.col("l_orderkey") % 2 == 0, "pm").otherwise("k").alias("platform"), F.col("l_suppkey").cast("string").alias("market_id")
    ).agg(side(bid).alias("b"), side(~bid).alias("a"), (F.max("l_orderkey") * 0 + 1_700_000_000).alias("ts"))
    level = lambda sign: lambda x: F.struct((x["o"] * sign).alias("price"), x["size"].alias("size"))
    return g.select("platform", "market_id", "ts", F.transform("b", level(-1)).alias("bids"), F.transform("a", level(1)).alias("asks"))


# The same views for DuckDB, as common table expressions; each names those it needs.
CTE = {
    "om": """om AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'pm' ELSE 'k' END AS platform, o_orderkey::VARCHAR AS market_id,
      CASE WHEN o_orderkey % 17 <> 0 THEN o_orderpriority END AS category, o_orderdate AS open_ts, closed AS close_ts,
      CASE o_orderstatus WHEN 'F' THEN 'YES' WHEN 'O' THEN 'NO' END AS outcome, CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice END AS volume
      FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS closed FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)""",
    "hm": """hm AS (SELECT *, (epoch(close_ts) - epoch(open_ts)) / 3600.0 AS lifetime_hours FROM om
      WHERE outcome IS NOT NULL AND open_ts IS NOT NULL AND close_ts IS NOT NULL AND epoch(close_ts) - epoch(open_ts) >= 86400)""",
    "ev": """ev AS (SELECT event_id, event_type IN ('view', 'click') AS ours, event_type, user_id, floor(epoch(ts))::BIGINT AS ts, value,
      json_extract_string(props, '$.k')::DOUBLE / 100 AS k, (event_id % 7) * 0.02::DOUBLE AS half FROM events)""",
    "pr": """pr AS (SELECT CASE WHEN ours THEN 'pm' ELSE 'k' END AS platform, user_id::VARCHAR AS market_id, ts,
      CASE WHEN event_type <> 'error' THEN k END AS price,
      CASE WHEN NOT ours THEN CASE WHEN event_id % 50 = 0 THEN least(k + half, 1.0) ELSE greatest(k - half, 0.0) END END AS bid,
      CASE WHEN NOT ours THEN CASE WHEN event_id % 50 = 0 THEN greatest(k - half, 0.0) ELSE least(k + half, 1.0) END END AS ask, value AS volume FROM ev)""",
    "us": """us AS (SELECT platform, market_id, ts, price FROM (SELECT platform, market_id, ts,
        CASE WHEN bid IS NULL OR ask IS NULL THEN price WHEN ask < bid OR ask - bid > 0.2 THEN NULL
          WHEN price >= bid - 0.05 AND price <= ask + 0.05 THEN price ELSE (bid + ask) / 2 END AS price FROM pr) WHERE price IS NOT NULL)""",
    "st": """st AS (SELECT *, max((price <> 0.5)::INT) OVER (PARTITION BY platform, market_id ORDER BY ts, price ROWS UNBOUNDED PRECEDING) AS begun FROM us),
      nb AS (SELECT *, CASE WHEN abs(price - 0.5) > 0.015 THEN price END AS far FROM st WHERE begun = 1 OR platform <> 'pm'),
      nn AS (SELECT *, last_value(far IGNORE NULLS) OVER (PARTITION BY platform, market_id ORDER BY ts, price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bef,
        first_value(far IGNORE NULLS) OVER (PARTITION BY platform, market_id ORDER BY ts, price ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS aft FROM nb),
      cl AS (SELECT platform, market_id, ts, price FROM nn WHERE NOT (platform = 'pm' AND far IS NULL AND coalesce(bef, aft) IS NOT NULL
        AND coalesce(abs(price - bef) > 0.05, true) AND coalesce(abs(price - aft) > 0.05, true)))""",
    "em": """em AS (SELECT CASE WHEN ours THEN 'pm' ELSE 'k' END AS platform, user_id, user_id::VARCHAR AS market_id, ['Sports','crypto','Politics','Weather','unknown'][user_id % 5 + 1] AS category,
      min(ts) AS opened, max(ts) + 43200 AS anchor,
      CASE WHEN user_id % 19 <> 0 THEN CASE WHEN (user_id % 3 <> 0) <> (NOT ours AND user_id % 11 = 0) THEN 'YES' ELSE 'NO' END END AS outcome,
      CASE WHEN user_id % 7 <> 0 THEN round(sum(value), 2) END AS volume, user_id % 20 AS cluster FROM ev GROUP BY ours, user_id)""",
    "hz": """hz AS (SELECT platform, market_id, horizon, arg_max(price, (ts, price)) AS p FROM cl JOIN (SELECT platform, market_id, anchor FROM em WHERE outcome IS NOT NULL) USING (platform, market_id),
        (VALUES ('1h', 3600), ('24h', 86400), ('7d', 604800)) h(horizon, back) WHERE ts <= anchor - back GROUP BY 1, 2, 3),
      sn AS (SELECT platform, market_id, horizon, p, (outcome = 'YES')::INT::DOUBLE AS y, category, volume, cluster FROM hz JOIN em USING (platform, market_id))""",
    "pa": """pa AS (SELECT a.market_id AS pm_id, b.market_id AS k_id, CASE WHEN a.user_id % 3 = 0 THEN 'inverse' ELSE 'same' END AS orientation, a.user_id % 8 <> 0 AS verified,
      a.user_id % 10 = 0 AS basis_risk, a.outcome AS pm_outcome, b.outcome AS k_outcome, a.category, to_timestamp(b.anchor)::TIMESTAMP::DATE AS resolve_day
      FROM em a JOIN em b ON a.market_id = b.market_id AND a.platform = 'pm' AND b.platform = 'k')""",
    "da": """da AS (SELECT platform, market_id, (TIMESTAMP '1970-01-01' + to_seconds(ts))::DATE AS day, arg_max(price, (ts, price)) AS price FROM cl GROUP BY 1, 2, 3)""",
    "dq": """dq AS (SELECT market_id, (TIMESTAMP '1970-01-01' + to_seconds(ts))::DATE AS day, arg_max(bid, (ts, bid, ask)) AS bid, arg_max(ask, (ts, bid, ask)) AS ask FROM pr WHERE bid IS NOT NULL AND ask IS NOT NULL GROUP BY 1, 2)""",
    "al": """al AS (SELECT pm_id, k_id, a.day, a.price AS pm, CASE WHEN orientation = 'inverse' THEN 1 - b.price ELSE b.price END AS k FROM pa JOIN da a ON a.platform = 'pm' AND a.market_id = pm_id
        JOIN da b ON b.platform = 'k' AND b.market_id = k_id AND b.day = a.day), sp AS (SELECT *, (pm - k) * 100.0 AS spread FROM al)""",
    "td": """td AS (SELECT pm_id, k_id, a.day, CASE WHEN orientation = 'inverse' THEN 1 - a.price ELSE a.price END AS pm, bid AS k_bid, ask AS k_ask, category, resolve_day,
        CASE WHEN orientation = 'inverse' THEN CASE WHEN pm_outcome = 'NO' THEN 'YES' ELSE 'NO' END ELSE pm_outcome END AS pm_outcome, k_outcome
      FROM pa JOIN da a ON a.platform = 'pm' AND a.market_id = pm_id JOIN dq b ON b.market_id = k_id AND b.day = a.day
      WHERE verified AND NOT basis_risk AND pm_outcome IS NOT NULL AND k_outcome IS NOT NULL AND a.day < resolve_day)""",
    "lv": """lv AS (SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'pm' ELSE 'k' END AS platform, l_suppkey::VARCHAR AS market_id, l_linenumber % 2 = 1 AS bid, l_quantity / CASE WHEN l_suppkey % 3 = 0 THEN 8.0::DOUBLE ELSE 1.0 END AS size,
        CASE WHEN l_linenumber % 2 = 1 THEN (48 - (round(abs(l_discount) * 100)::INT * 3 + l_linenumber)) / 100.0::DOUBLE ELSE (52 + (round(abs(l_discount) * 100)::INT * 3 + l_linenumber)) / 100.0::DOUBLE END AS price
      FROM lineitem)""",
    "bk": """bs AS (SELECT platform, market_id, 1700000000::BIGINT AS ts, max(price) FILTER (bid) AS best_bid, min(price) FILTER (NOT bid) AS best_ask,
        coalesce(sum(price * size) FILTER (bid), 0) AS bid_depth, coalesce(sum(price * size) FILTER (NOT bid), 0) AS ask_depth FROM lv GROUP BY 1, 2),
      ld AS (SELECT platform, market_id, 'ask' AS side, price, size FROM lv WHERE NOT bid UNION ALL SELECT platform, market_id, 'no' AS side, 1 - price, size FROM lv WHERE bid),
      cu AS (SELECT *, sum(price * size) OVER (PARTITION BY platform, market_id, side ORDER BY price, size ROWS UNBOUNDED PRECEDING) - price * size AS prior FROM ld WHERE price > 0 AND size > 0),
      fl AS (SELECT platform, market_id, side, n, sum(greatest(least(price * size, n - prior), 0)) AS filled, sum(greatest(least(price * size, n - prior), 0) / price) AS contracts
        FROM cu, (VALUES (50), (200), (1000)) z(n) GROUP BY 1, 2, 3, 4),
      vw AS (SELECT platform, market_id, side, n, CASE WHEN filled >= n - 1e-9 THEN filled / nullif(contracts, 0) END AS vwap FROM fl)""",
}
_NEEDS = {"hm": ["om"], "pr": ["ev"], "us": ["pr"], "st": ["us"], "em": ["ev"], "hz": ["st", "em"], "pa": ["em"], "da": ["st"], "dq": ["pr"], "al": ["da", "pa"], "td": ["da", "dq", "pa"], "bk": ["lv"]}


def with_views(names: str, select: str) -> str:
    """A statement over the named views, those they need first."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in _NEEDS.get(name, []):
            visit(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        visit(name)
    return "WITH " + ",\n".join(CTE[n] for n in order) + "\n" + select
