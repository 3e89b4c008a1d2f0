"""Commands over a folder of market tables: the steps of an analysis, each reading tables and writing tables or reports.

The tables (Parquet in one folder): ``markets`` (platform, market_id, title, category, series, open_ts, close_ts, outcome, volume, liquidity, raw_json),
``prices`` (platform, market_id, ts, price, bid, ask, volume), ``matches`` (pm_id, k_id, score, method, verified, orientation, basis_risk),
``book_snapshots`` and ``paper_signals``.
"""

from __future__ import annotations

import argparse
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import parse
from .functions.prices import usable_price
from .operators import backtest as BT, books as B, calibration as C, divergence as D, matching as M, quality as Q, series as S, stats as X, tables as T, verify as V
from .session import local_session
from .sources import archive as A
from .streaming import live

SCHEMAS = {
    "markets": "platform string, market_id string, title string, category string, series string, open_ts timestamp, close_ts timestamp, outcome string, volume double, liquidity double, raw_json string",
    "prices": "platform string, market_id string, ts bigint, price double, bid double, ask double, volume double",
    "matches": "pm_id string, k_id string, score double, method string, verified boolean, orientation string, basis_risk boolean",
}
KEYS = {"markets": ["platform", "market_id"], "prices": ["platform", "market_id", "ts"], "matches": ["pm_id", "k_id"]}


class Store:
    """Tables as folders of versions, named by their time; the newest that was written whole (it has the writer's mark) counts, so readers see old or new."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self, name: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        mark = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(v for v in (f.getPath().getName() for f in files.listStatus(path)) if files.exists(mark(f"{self.root}/{name}/{v}/_SUCCESS")))

    def _pointer(self, name: str) -> str | None:
        return (self._versions(name) or [None])[-1]

    def read(self, name: str) -> DataFrame:
        version = self._pointer(name)
        if version is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}/{version}")

    def write(self, name: str, rows: DataFrame) -> None:
        last = self._pointer(name)
        version = f"{max(int(time.time() * 1000), int(last.split('-')[0]) + 1 if last else 0):015d}-{uuid.uuid4().hex[:8]}"
        rows.select(*self.spark.createDataFrame([], SCHEMAS[name]).columns).write.parquet(f"{self.root}/{name}/{version}")

    def upsert(self, name: str, rows: DataFrame) -> None:
        self.write(name, T.upsert(self.read(name), rows, KEYS[name]))


def init_db(store: Store, args) -> None:
    for name in SCHEMAS:
        if store._pointer(name) is None:
            store.write(name, store.spark.createDataFrame([], SCHEMAS[name]))


def ingest(store: Store, args) -> None:
    """Archived responses of one venue and stage into the tables."""
    if args.platform not in ("pm", "k") or args.stage not in ("markets", "prices"):
        raise ValueError("platform is pm or k, stage is markets or prices")
    raw = A.latest_responses(A.responses(store.spark, args.archive))
    if args.stage == "markets":
        if args.platform == "pm":
            rows = parse.pm_markets(A.records(raw, parse.PM_MARKET)).withColumn("series", F.lit(None).cast("string"))
        else:
            rows = parse.k_markets(A.records(raw, parse.K_MARKET, "markets")).withColumn("category", F.lit(None).cast("string"))
        store.upsert("markets", rows.withColumns({c: F.col(c).cast("timestamp") for c in ("open_ts", "close_ts")}))
    elif args.platform == "pm":
        history = raw.select(F.regexp_extract("url", r"market=([^&]+)", 1).alias("id"), F.from_json("body", parse.PM_HISTORY.replace(" array", ":array").join(("struct<", ">"))).alias("b"))
        store.upsert("prices", parse.pm_prices(history.select("id", "b.history"), F.col("id")))
    else:
        candles = raw.select(F.from_json("body", f"struct<{parse.K_CANDLES.replace('ticker string, candlesticks ', 'ticker:string,candlesticks:')}>").alias("b")).select("b.*")
        store.upsert("prices", parse.k_prices(candles))


def clean_prices(store: Store) -> DataFrame:
    p = store.read("prices").withColumn("price", usable_price(F.col("price"), F.col("bid"), F.col("ask"))).where("price is not null")
    return S.strip_placeholder(p.select("platform", "market_id", "ts", "price"))


def match(store: Store, args) -> None:
    m = store.read("markets")
    if args.since:
        m = M.closing_between(m, args.since, args.until)
    inputs = M.match_inputs(m)
    found = M.build_candidates(inputs.where("platform = 'pm'"), inputs.where("platform = 'k'"), args.threshold)
    store.write("matches", M.replace_candidates(store.read("matches"), found))
    out = M.enriched(M.with_both_priced(store.read("matches"), store.read("prices")), m)
    T.write_csv(out, f"{args.out}/match_candidates", F.col("score").desc(), "pm_id", "k_id")


def verify(store: Store, args) -> None:
    codes = V.decide(A.review_lines(store.spark, args.review))
    store.write("matches", V.apply_verdicts(store.read("matches"), codes))


def fetch_pair_prices(store: Store, args) -> None:
    """The markets of verified pairs that have no prices yet, for a fetcher to work on."""
    pairs = store.read("matches").where("verified")
    need = pairs.select(F.lit("pm").alias("platform"), F.col("pm_id").alias("market_id")).union(pairs.select(F.lit("k"), "k_id"))
    T.write_csv(T.missing(need.distinct(), store.read("prices").select("platform", "market_id").distinct(), ["platform", "market_id"]), f"{args.out}/missing_prices", "platform", "market_id")


def snapshots(store: Store) -> DataFrame:
    m = Q.headline_markets(store.read("markets")).withColumn("anchor", F.unix_timestamp("close_ts"))
    at = S.price_at_horizons(clean_prices(store), m, {"1h": 3_600, "24h": 86_400, "7d": 604_800})
    keep = m.select("platform", "market_id", "category", "volume", "outcome", parse.cluster_id(F.col("platform"), F.col("raw_json"), F.col("market_id")).alias("cluster"))
    out = at.join(keep, ["platform", "market_id"])
    return out.withColumns({"p": F.col("snapshot"), "y": (F.col("outcome") == "YES").cast("double")})


def calibrate(store: Store, args) -> None:
    s = snapshots(store)
    day = s.where("horizon = '24h'")
    T.write_csv(C.murphy(s, "platform", "horizon", least=100), f"{args.out}/calibration_horizons", "platform", "horizon")
    T.write_csv(C.calibration_table(day, "platform"), f"{args.out}/calibration_table", "platform", "bin_low")
    T.write_csv(C.longshot_favourite(day, "platform"), f"{args.out}/longshot_favourite", "platform", "segment")
    T.write_csv(C.murphy(C.volume_tercile(day, "platform"), "platform", "tercile"), f"{args.out}/calibration_terciles", "platform", "tercile")
    T.write_csv(C.paired_sharpening(s, ("24h", "7d")), f"{args.out}/calibration_paired", "platform", "horizon")


def pairs_of(store: Store) -> DataFrame:
    m = store.read("markets")
    one = m.where("platform = 'pm'").select(F.col("market_id").alias("pm_id"), F.col("outcome").alias("pm_outcome"), "category")
    two = m.where("platform = 'k'").select(F.col("market_id").alias("k_id"), F.col("outcome").alias("k_outcome"), F.to_date("close_ts").alias("resolve_day"))
    return store.read("matches").where("verified").join(one, "pm_id").join(two, "k_id")


def daily(store: Store, venue: str) -> DataFrame:
    return S.daily_last(clean_prices(store).where(F.col("platform") == venue), "price")


def diverge(store: Store, args) -> None:
    aligned = D.align_pairs(pairs_of(store), daily(store, "pm"), daily(store, "k"))
    per = D.pair_table(aligned).join(store.read("matches").select("pm_id", "k_id", "basis_risk"), ["pm_id", "k_id"])
    T.write_csv(per, f"{args.out}/divergence_pairs", F.col("mean_abs").desc(), "pm_id", "k_id")
    T.write_csv(D.divergence_summary(per), f"{args.out}/divergence_summary")
    T.write_csv(D.divergence_summary(per.where("not basis_risk")), f"{args.out}/divergence_summary_same_criteria")
    T.write_csv(D.lead_lag_summary(aligned), f"{args.out}/lead_lag", "lag")
    T.write_csv(D.histogram(aligned), f"{args.out}/spread_histogram", "bin")
    T.write_csv(D.case_studies(per), f"{args.out}/case_studies")


def backtest(store: Store, args) -> None:
    quotes = S.daily_last(store.read("prices").where("platform = 'k' and bid is not null and ask is not null"), "bid", "ask")
    days = BT.tradable_days(pairs_of(store), daily(store, "pm"), quotes)
    trades = BT.run_backtest(days)
    T.write_csv(BT.backtest_summary(trades, days), f"{args.out}/backtest_summary", "slippage")
    T.write_csv(trades.where("slippage = 1"), f"{args.out}/backtest_trades", F.col("edge").desc(), "pm_id", "k_id")


def predict(store: Store, args) -> None:
    from .functions.titles import category_bucket

    m = Q.headline_markets(store.read("markets")).withColumns({"anchor": F.unix_timestamp("close_ts"), "bucket": category_bucket(F.col("platform"), F.col("category"))})
    T.write_csv(X.model_comparison(X.feature_frame(clean_prices(store), m)), f"{args.out}/prediction", "model")


def robustness(store: Store, args) -> None:
    s = snapshots(store).where("horizon = '24h'")
    T.write_csv(X.design_effect(s, "y", "cluster", "platform", n_boot=800), f"{args.out}/design_effect", "platform")
    T.write_csv(X.robustness(s), f"{args.out}/robustness", "platform", "segment")


def quality_report(store: Store, args) -> None:
    m, p = store.read("markets"), store.read("prices")
    h = Q.headline_markets(m)
    parts = {
        "counts": Q.market_counts(m), "coverage": Q.date_coverage(h), "outcomes": Q.outcome_distribution(h), "categories": Q.top_categories(h), "prices": Q.price_stats(p, m),
        "base_rates": Q.base_rates(h), "months": Q.monthly_counts(h), "shares": Q.category_shares(h), "last_price": Q.last_price_calibration(p, h),
    }
    for name, rows in parts.items():
        T.write_csv(rows, f"{args.out}/quality_{name}", *rows.columns[:2])


def paper_trade(store: Store, args) -> None:
    pairs = store.read("matches").where("verified").join(store.read("markets").where("platform = 'pm'").select(F.col("market_id").alias("pm_id"), "category"), "pm_id")
    stream = live.book_stream(store.spark, args.books)
    live.trade_on_paper(stream, pairs, f"{store.root}/paper_signals", f"{store.root}/_checkpoints/paper", args.interval, once=not args.repeat).awaitTermination()


def paper_report(store: Store, args) -> None:
    signals = live.recorded_signals(store.spark, f"{store.root}/paper_signals")
    settled = B.settle(signals, store.read("markets"))
    T.write_csv(B.signal_summary(signals), f"{args.out}/signal_summary", "view")
    T.write_csv(B.edge_decay(signals), f"{args.out}/edge_decay")
    T.write_csv(B.settled_summary(settled), f"{args.out}/settled_summary")


def run_all(store: Store, args) -> None:
    for step in (match, calibrate, diverge, backtest, predict, robustness, quality_report):
        began = time.time()
        step(store, args)
        print(f"{step.__name__}: {time.time() - began:.1f} s", flush=True)


COMMANDS = {
    f.__name__.replace("_", "-"): f
    for f in (init_db, ingest, match, verify, fetch_pair_prices, calibrate, diverge, backtest, predict, run_all, robustness, paper_trade, paper_report, quality_report)
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="oddsmill", description=__doc__)
    parser.add_argument("command", choices=sorted(COMMANDS))
    parser.add_argument("--tables", default=os.environ.get("ODDSMILL_TABLES", "tables"))
    parser.add_argument("--out", default="reports")
    parser.add_argument("--archive", default="archive")
    parser.add_argument("--platform", default="pm")
    parser.add_argument("--stage", default="markets")
    parser.add_argument("--threshold", type=float, default=85.0)
    parser.add_argument("--since")
    parser.add_argument("--until")
    parser.add_argument("--review", default="review.jsonl")
    parser.add_argument("--books", default="books")
    parser.add_argument("--interval", default="15 minutes")
    parser.add_argument("--repeat", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    COMMANDS[args.command](Store(spark, args.tables), args)


if __name__ == "__main__":
    main()
