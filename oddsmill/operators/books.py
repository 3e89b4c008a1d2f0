
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.prices import taker_fee
from .backtest import K_FEE, pm_fee

LEVELS = "array<struct<price:double,size:double>>"
PAIR_BOOK = "struct<orderbook_fp:struct<yes_dollars:array<array<string>>,no_dollars:array<array<string>>>,orderbook:struct<yes:array<array<string>>,no:array<array<string>>>>"
STRUCT_BOOK = "struct<bids:array<struct<price:string,size:string>>,asks:array<struct<price:string,size:string>>>"
SIZES = (50, 200, 1000)


def level(price: Column, size: Column) -> Column:
    return F.struct(price.cast("double").alias("price"), size.cast("double").alias("size"))


def best_first(levels: Column, bids: bool) -> Column:
    """[P17] Levels with a size, bids from the highest, asks from the lowest price; equal prices by size."""
    found = F.filter(F.coalesce(levels, F.array().cast(LEVELS)), lambda x: (x["size"] > 0) & x["price"].isNotNull())
    if not bids:
        return F.array_sort(found)
    key = F.array_sort(F.transform(found, lambda x: F.struct((-x["price"]).alias("price"), x["size"].alias("size"))))
    return F.transform(key, lambda x: F.struct((-x["price"]).alias("price"), x["size"].alias("size")))


def mirrored(levels: Column) -> Column:
    """[B10] The other side's offers at 1 - price."""
    return F.transform(levels, lambda x: F.struct((1 - x["price"]).alias("price"), x["size"].alias("size")))


def pair_ladder_book(payload: Column) -> tuple[Column, Column]:
    """[P15] Bids and asks from two bid ladders of [price, size] strings, in either spelling; a NO bid at q is a YES ask at 1 - q."""
    raw = F.from_json(payload, PAIR_BOOK)
    read = lambda rows: F.transform(rows, lambda x: level(F.get(x, F.lit(0)).try_cast("double"), F.get(x, F.lit(1)).try_cast("double")))
    yes = read(F.coalesce(raw["orderbook_fp"]["yes_dollars"], raw["orderbook"]["yes"]))
    no = read(F.coalesce(raw["orderbook_fp"]["no_dollars"], raw["orderbook"]["no"]))
    return best_first(yes, True), best_first(mirrored(no), False)


def struct_book(payload: Column) -> tuple[Column, Column]:
    """[P16] Bids and asks from lists of price and size."""
    raw = F.from_json(payload, STRUCT_BOOK)
    read = lambda rows: F.transform(rows, lambda x: level(x["price"].try_cast("double"), x["size"].try_cast("double")))
    return best_first(read(raw["bids"]), True), best_first(read(raw["asks"]), False)


def spent(levels: Column, notional: Column | float) -> Column:
    """struct(filled, contracts, levels) after spending up to notional dollars down the levels; a level without a positive price is skipped."""
    notional = notional if isinstance(notional, Column) else F.lit(float(notional))
    state = F.struct(F.lit(0.0).alias("filled"), F.lit(0.0).alias("contracts"), F.lit(0).alias("levels"))

    def step(s: Column, x: Column) -> Column:
        spend = F.greatest(F.least(x["price"] * x["size"], notional - s["filled"]), F.lit(0.0))
        used = (x["price"] > 0) & (spend > 0)
        return F.struct(
            F.when(used, s["filled"] + spend).otherwise(s["filled"]).alias("filled"),
            F.when(used, s["contracts"] + F.try_divide(spend, x["price"])).otherwise(s["contracts"]).alias("contracts"),
            F.when(used, s["levels"] + 1).otherwise(s["levels"]).alias("levels"),
        )

    return F.aggregate(levels, state, step)


def average_price(done: Column) -> Column:
    return F.try_divide(done["filled"], F.nullif(done["contracts"], F.lit(0.0)))


def complete(done: Column, notional: Column | float) -> Column:
    """Exactly enough depth is enough."""
    return done["filled"] >= notional - 1e-9


def walk(levels: Column, notional: Column | float) -> Column:
    """[B8] struct(filled, contracts, vwap, levels, complete); nothing to spend is complete without a price."""
    done = spent(levels, notional)
    return F.struct(done["filled"].alias("filled"), done["contracts"].alias("contracts"), average_price(done).alias("vwap"), done["levels"].alias("levels"), complete(done, notional).alias("complete"))


def executable_cost(levels: Column, notional: Column | float) -> Column:
    """[B9] Average price for notional dollars; null if the book can't fill them."""
    done = spent(levels, notional)
    return F.when(complete(done, notional), average_price(done))


def best_price(levels: Column) -> Column:
    return F.get(levels, F.lit(0))["price"]


def slippage_points(vwap: Column, best: Column) -> Column:
    """[B11]"""
    return (vwap - best) * 100


def depth(levels: Column) -> Column:
    """[B14] Dollars on the levels."""
    return F.aggregate(levels, F.lit(0.0), lambda s, x: s + x["price"] * x["size"])


def snapshots(books: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """[B14, S11] books(platform, market_id, ts, bids, asks) to touch, average prices and depths; empty books are left out."""
    some = books.where((F.size("bids") > 0) | (F.size("asks") > 0))
    return some.select(
        "platform",
        "market_id",
        "ts",
        best_price(F.col("bids")).alias("best_bid"),
        best_price(F.col("asks")).alias("best_ask"),
        *(executable_cost(F.col("asks"), n).alias(f"vwap_{n}") for n in sizes),
        depth(F.col("bids")).alias("bid_depth"),
        depth(F.col("asks")).alias("ask_depth"),
    )


def _all_in(yes: Column, no: Column, yes_fee: Column, no_fee: Column) -> Column:
    return yes + taker_fee(yes_fee, yes) + no + taker_fee(no_fee, no)


def cheaper_way(pm_yes: Column, k_no: Column, k_yes: Column, pm_no: Column, fee: Column, k_fee: float = K_FEE) -> Column:
    """[B12] struct(direction, cost, edge) of the cheaper of the two ways; a way with a side that can't be had is skipped."""
    one, two = _all_in(pm_yes, k_no, fee, F.lit(k_fee)), _all_in(k_yes, pm_no, F.lit(k_fee), fee)
    cost = F.least(one, two)
    second = two.isNotNull() & (one.isNull() | (two < one))
    return F.struct(F.when(second, "k_yes").otherwise("pm_yes").alias("direction"), cost.alias("cost"), (1 - cost).alias("edge"))


def price_pair(fee: Column, notional: float | None, k_fee: float = K_FEE) -> Column:
    """[B12] The cheaper way over the columns pm_bids, pm_asks, k_bids, k_asks: at the touch, or for so many dollars a leg."""
    quote = best_price if notional is None else lambda levels: executable_cost(levels, notional)
    return cheaper_way(quote(F.col("pm_asks")), quote(mirrored(F.col("k_bids"))), quote(F.col("k_asks")), quote(mirrored(F.col("pm_bids"))), fee, k_fee)


def evaluate(pairs: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """[B13] pairs(pm_id, k_id, ts, category, pm_bids, pm_asks, k_bids, k_asks) to signals: the touch, and each size.

    Ladders are walked once each, in a projection of their own; later projections only read the result.
    """
    ladders = {"pm_yes": F.col("pm_asks"), "k_no": mirrored(F.col("k_bids")), "k_yes": F.col("k_asks"), "pm_no": mirrored(F.col("pm_bids"))}
    out = pairs.withColumns({f"_{k}": v for k, v in ladders.items()} | {"_fee": pm_fee(F.col("category"))})
    out = out.withColumns({f"_{k}_{n}": spent(F.col(f"_{k}"), n) for k in ladders for n in sizes} | {f"_{k}_0": best_price(F.col(f"_{k}")) for k in ladders})
    out = out.withColumns({f"_{k}_{n}": F.when(complete(F.col(f"_{k}_{n}"), n), average_price(F.col(f"_{k}_{n}"))) for k in ladders for n in sizes})
    out = out.withColumns({f"_at_{n}": cheaper_way(*(F.col(f"_{k}_{n}") for k in ladders), F.col("_fee")) for n in (0, *sizes)})
    costs = [c for n in sizes for c in (F.col(f"_at_{n}.cost").alias(f"exec_cost_{n}"), F.col(f"_at_{n}.edge").alias(f"exec_edge_{n}"))]
    best = [best_price(F.col(f"{v}_{s}s")).alias(f"{v}_best_{s}") for v in ("pm", "k") for s in ("ask", "bid")]
    return out.select("pm_id", "k_id", "ts", F.col("_at_0.direction").alias("direction"), F.col("_at_0.cost").alias("touch_cost"), F.col("_at_0.edge").alias("touch_edge"), *costs, *best)


def depth_cost(shots: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """[A22] Mean slippage in points per platform and size, over the books that can fill it."""
    columns = [F.avg(slippage_points(F.col(f"vwap_{n}"), F.col("best_ask"))).alias(f"cost_{n}") for n in sizes]
    return shots.where("best_ask is not null").groupBy("platform").agg(F.count(F.lit(1)).alias("books"), *columns)


def depth_quartiles(shots: DataFrame, size: int = 200, least: int = 12) -> DataFrame:
    """[A23] Median slippage of thin, middle and deep books per platform with enough books."""
    rows = shots.where(f"vwap_{size} is not null and best_ask is not null and ask_depth > 0").withColumn("slip", slippage_points(F.col(f"vwap_{size}"), F.col("best_ask")))
    cuts = rows.groupBy("platform").agg(F.percentile("ask_depth", F.array(F.lit(0.25), F.lit(0.75))).alias("_q"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    band = F.when(F.col("ask_depth") <= F.get("_q", F.lit(0)), "thin").when(F.col("ask_depth") <= F.get("_q", F.lit(1)), "middle").otherwise("deep")
    return rows.join(cuts, "platform").groupBy("platform", band.alias("band")).agg(F.count(F.lit(1)).alias("books"), F.median("ask_depth").alias("median_depth"), F.median("slip").alias("median_slip"))


def signal_summary(signals: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """[A24] Per view (touch, then each size): signals, positive edges, median edge, and how many could not be filled."""
    views = [("touch", "touch_edge"), *((str(n), f"exec_edge_{n}") for n in sizes)]
    long = signals.select(F.explode(F.array(*(F.struct(F.lit(k).alias("view"), F.col(c).alias("edge")) for k, c in views))).alias("v")).select("v.*")
    return long.groupBy("view").agg(F.count(F.lit(1)).alias("signals"), F.count_if(F.col("edge") > 0).alias("positive"), F.median("edge").alias("median_edge"), F.count_if(F.col("edge").isNull()).alias("unfillable"))


def edge_decay(signals: DataFrame, size: int = 200) -> DataFrame:
    """[A25] From the touch to a size, where both have a price: median and mean loss of edge, and edges that turned."""
    both = signals.where(f"touch_edge is not null and exec_edge_{size} is not null").withColumn("loss", F.col("touch_edge") - F.col(f"exec_edge_{size}"))
    turned = F.count_if((F.col("touch_edge") > 0) & (F.col(f"exec_edge_{size}") <= 0))
    return both.agg(F.count(F.lit(1)).alias("signals"), F.median("loss").alias("median_loss"), F.avg("loss").alias("mean_loss"), turned.alias("turned"))


def settle(signals: DataFrame, markets: DataFrame) -> DataFrame:
    """[D7, J6, A26] signals whose two markets have an outcome, with payout and pnl of the touch direction."""
    from .backtest import realized_payout

    known = markets.where("outcome is not null")
    one = known.where("platform = 'pm'").select(F.col("market_id").alias("pm_id"), F.col("outcome").alias("pm_outcome"))
    two = known.where("platform = 'k'").select(F.col("market_id").alias("k_id"), F.col("outcome").alias("k_outcome"))
    payout = realized_payout(F.col("direction"), F.col("pm_outcome"), F.col("k_outcome"))
    return signals.join(one, "pm_id").join(two, "k_id").withColumn("payout", payout).withColumn("pnl", F.col("payout") - F.col("touch_cost"))


def settled_summary(settled: DataFrame) -> DataFrame:
    """[A26]"""
    return settled.agg(F.count(F.lit(1)).alias("settled"), F.count_if(F.col("payout") == 1.0).alias("paid_1"), F.count_if(F.col("payout") != 1.0).alias("paid_other"), F.sum("pnl").alias("pnl"))
