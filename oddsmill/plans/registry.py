"""Every query of the engine by name, and its DuckDB twin.

Doubles are rounded to nine places on both sides, as sums of doubles depend on their order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import parse, titles
from ..functions.prices import coverage_ratio, percent, wilson_interval
from ..operators import backtest as BT, books as B, calibration as C, divergence as D, matching as M, quality as Q, series as S, stats as X, tables as T, verify as V
from ..session import shared_root
from ..sources import archive as A
from ..sources.archive import table
from ..streaming import live
from . import views as W

_QUERIES: dict = {}
_ORACLES: dict = {}


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(oracle: str | None = None):
    def add(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            return rounded(f(spark, d))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        _QUERIES[f.__name__] = run
        if oracle:
            _ORACLES[f.__name__] = oracle
        return run

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_ORACLES)


def r(*columns: str) -> str:
    """Rounded columns ``expression AS name`` of a DuckDB select."""
    out = []
    for c in columns:
        expression, _, name = c.rpartition(" AS ")
        out.append(f"round({expression or name}, 9) + 0.0 AS {name}")
    return ", ".join(out)


# --- prices ---------------------------------------------------------------------------------------------------------

WILSON = """CASE WHEN n = 0 THEN 0.0 ELSE greatest(0.0, (hits / n + 3.8416 / n / 2 - 1.96 * sqrt(hits / n * (1 - hits / n) / n + 3.8416 / n / (4 * n))) / (1 + 3.8416 / n)) END AS ci_low,
    CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, (hits / n + 3.8416 / n / 2 + 1.96 * sqrt(hits / n * (1 - hits / n) / n + 3.8416 / n / (4 * n))) / (1 + 3.8416 / n)) END AS ci_high"""
WILSON = ", ".join(f"round({x.rpartition(' AS ')[0]}, 9) + 0.0 AS {x.rpartition(' AS ')[2]}" for x in WILSON.split(",\n    "))
BIN = "greatest(0, least(9, floor(p * 10)))::INT"


@query(W.with_views("us", f"SELECT platform, market_id, ts, {r('price')} FROM us"))
def usable_prices(spark, d):
    """one usable price per row."""
    return W.usable(spark, d)


@query(W.with_views("pr", f"SELECT platform, market_id, ts, {r('coalesce(price, (bid + ask) / 2) AS prob')} FROM pr"))
def midpoint_prices(spark, d):
    """the looser rule of the report queries."""
    return W.prices(spark, d).select("platform", "market_id", "ts", F.coalesce("price", (F.col("bid") + F.col("ask")) / 2).alias("prob"))


@query(W.with_views("st", f"SELECT platform, market_id, ts, {r('price')} FROM cl"))
def stripped_prices(spark, d):
    """Prices without placeholders."""
    return W.clean(spark, d)


@query(W.with_views("hz", f"SELECT platform, market_id, horizon, {r('p AS snapshot')} FROM hz"))
def price_at_horizons(spark, d):
    """The last price so long before close."""
    return S.price_at_horizons(W.clean(spark, d), W.event_markets(spark, d).where("outcome is not null"), W.HORIZONS)


@query(W.with_views("da", f"SELECT platform, market_id, day, {r('price')} FROM da"))
def daily_series(spark, d):
    """W5."""
    return S.daily_last(W.clean(spark, d), "price")


@query(W.with_views("pr", f"SELECT platform, market_id, ts, {r('price')} FROM (SELECT *, row_number() OVER (PARTITION BY platform, market_id ORDER BY ts DESC, price DESC NULLS LAST) AS rn FROM pr) WHERE rn = 1"))
def latest_prices(spark, d):
    """W3."""
    return S.latest_per_key(W.prices(spark, d), "price")


# --- calibration ----------------------------------------------------------------------------------------------------


@query(W.with_views("hz", f"""SELECT platform, bin / 10.0::DOUBLE AS bin_low, n, {r('mean_p', 'yes_rate')}, {WILSON}
  FROM (SELECT platform, {BIN} AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS yes_rate, sum(y) AS hits FROM sn WHERE horizon = '24h' GROUP BY 1, 2)"""))
def calibration_table(spark, d):
    """The flagship."""
    return C.calibration_table(W.snapshots(spark, d).where("horizon = '24h'"), "platform")


MURPHY = """SELECT {keys}, sum(n)::BIGINT AS n, {cols} FROM (SELECT *, sum(hits) OVER w / sum(n) OVER w AS br FROM
  (SELECT {keys}, {bin} AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS rt, sum(y) AS hits, sum((p - y) * (p - y)) AS se FROM {source} GROUP BY {keys}, bin) WINDOW w AS (PARTITION BY {keys}))
  GROUP BY {keys} HAVING sum(n) >= {least}"""


def murphy_sql(keys: str, source: str, least: int = 1) -> str:
    cols = r("max(br) AS base_rate", "sum(se) / sum(n) AS brier", "sum(n * (mp - rt) * (mp - rt)) / sum(n) AS reliability", "sum(n * (rt - br) * (rt - br)) / sum(n) AS resolution", "max(br) * (1 - max(br)) AS uncertainty")
    return W.with_views("hz", MURPHY.format(keys=keys, cols=cols, bin=BIN, source=source, least=least))


@query(murphy_sql("platform, horizon", "sn", 20))
def horizon_table(spark, d):
    """A9, A10, A15."""
    return C.murphy(W.snapshots(spark, d), "platform", "horizon", least=20)


@query(murphy_sql("platform, category", "(SELECT * FROM sn WHERE horizon = '24h')", 5))
def category_calibration(spark, d):
    """A13."""
    return C.murphy(W.snapshots(spark, d).where("horizon = '24h'"), "platform", "category", least=5)


@query(murphy_sql("platform, tercile", """(SELECT *, CASE WHEN coalesce(volume, 0) < q[1] THEN 0 WHEN coalesce(volume, 0) < q[2] THEN 1 ELSE 2 END AS tercile FROM sn
   JOIN (SELECT platform, quantile_cont(coalesce(volume, 0), [1/3, 2/3]) AS q FROM sn WHERE horizon = '24h' GROUP BY 1) USING (platform) WHERE horizon = '24h')"""))
def tercile_calibration(spark, d):
    """A14."""
    return C.murphy(C.volume_tercile(W.snapshots(spark, d).where("horizon = '24h'"), "platform"), "platform", "tercile")


@query(W.with_views("hz", f"""SELECT platform, horizon, segment, n, {r('mean_p', 'yes_rate')}, {WILSON} FROM
  (SELECT platform, horizon, CASE WHEN p < 0.1 THEN 'longshot' ELSE 'favourite' END AS segment, count(*) AS n, avg(p) AS mean_p, avg(y) AS yes_rate, sum(y) AS hits FROM sn WHERE p < 0.1 OR p > 0.9 GROUP BY 1, 2, 3)"""))
def longshot_favourite(spark, d):
    """A12."""
    return C.longshot_favourite(W.snapshots(spark, d), "platform", "horizon")


@query(murphy_sql("platform, horizon", "(SELECT * FROM sn WHERE horizon <> '1h' AND (platform, market_id) IN (SELECT (platform, market_id) FROM sn WHERE horizon = '24h' INTERSECT SELECT (platform, market_id) FROM sn WHERE horizon = '7d'))", 5))
def paired_sharpening(spark, d):
    """A16, J11."""
    return C.paired_sharpening(W.snapshots(spark, d), ("24h", "7d"), least=5)


# --- divergence -----------------------------------------------------------------------------------------------------


def aligned(spark, d):
    return D.align_pairs(W.pairs(spark, d), W.daily(spark, d, "pm"), W.daily(spark, d, "k"))


@query(W.with_views("al", f"SELECT pm_id, k_id, day, {r('pm', 'k', 'spread')} FROM sp"))
def aligned_pairs(spark, d):
    """J3, J7, F5."""
    return aligned(spark, d)


SPREADS = r("avg(abs(spread)) AS mean_abs", "max(abs(spread)) AS max_abs", *(f"avg((abs(spread) > {x})::INT::DOUBLE) * 100 AS pct_gt{x}" for x in (2, 5, 10)))


@query(W.with_views("al", f"SELECT pm_id, k_id, count(*) AS n_days, {SPREADS} FROM sp GROUP BY 1, 2"))
def spread_statistics(spark, d):
    """A17."""
    return D.spread_stats(aligned(spark, d), "pm_id", "k_id")


# one row of state per day: (open, peak, its place, the gap before, ended event or null)
HALVES = W.with_views("al", """, g AS (SELECT pm_id, k_id, abs(spread) AS gap, row_number() OVER (PARTITION BY pm_id, k_id ORDER BY day) AS i FROM sp)""").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """,
walk(pm_id, k_id, i, is_open, peak, since, gap, ended) AS (
  SELECT pm_id, k_id, i, gap >= 5, CASE WHEN gap >= 5 THEN gap ELSE 0 END, i, gap, NULL::DOUBLE FROM g WHERE i = 1
  UNION ALL
  SELECT g.pm_id, g.k_id, g.i,
    CASE WHEN w.is_open THEN g.gap > w.peak / 2 ELSE g.gap >= 5 AND w.gap < 5 END,
    CASE WHEN (NOT w.is_open AND g.gap >= 5 AND w.gap < 5) OR (w.is_open AND g.gap > w.peak / 2 AND g.gap >= 5 AND g.gap > w.peak) THEN g.gap ELSE w.peak END,
    CASE WHEN (NOT w.is_open AND g.gap >= 5 AND w.gap < 5) OR (w.is_open AND g.gap > w.peak / 2 AND g.gap >= 5 AND g.gap > w.peak) THEN g.i ELSE w.since END,
    g.gap, CASE WHEN w.is_open AND g.gap <= w.peak / 2 THEN (g.i - w.since)::DOUBLE END
  FROM walk w JOIN g ON g.pm_id = w.pm_id AND g.k_id = w.k_id AND g.i = w.i + 1)
"""


@query(HALVES + f"""SELECT pm_id, k_id, n_days, mean_abs, max_abs, pct_gt2, pct_gt5, pct_gt10, coalesce(half_lives, '') AS half_lives
  FROM (SELECT pm_id, k_id, count(*) AS n_days, {SPREADS} FROM sp GROUP BY 1, 2 HAVING count(*) >= 2)
  LEFT JOIN (SELECT pm_id, k_id, string_agg(ended::INT::VARCHAR, ',' ORDER BY i) AS half_lives FROM walk WHERE ended IS NOT NULL GROUP BY 1, 2) USING (pm_id, k_id)""")
def pair_divergence(spark, d):
    """A18, W9."""
    out = D.pair_table(aligned(spark, d))
    return out.withColumn("half_lives", F.array_join(F.transform("half_lives", lambda x: x.cast("int").cast("string")), ","))


@query(HALVES + f"""SELECT * FROM (SELECT count(*) AS pairs, sum(n_days)::BIGINT AS pair_days, {r(*(f'sum({c} * n_days) / sum(n_days) AS {c}' for c in ('mean_abs', 'pct_gt2', 'pct_gt5', 'pct_gt10')))}
  FROM (SELECT pm_id, count(*) AS n_days, avg(abs(spread)) AS mean_abs, avg((abs(spread) > 2)::INT) * 100 AS pct_gt2, avg((abs(spread) > 5)::INT) * 100 AS pct_gt5, avg((abs(spread) > 10)::INT) * 100 AS pct_gt10 FROM sp GROUP BY 1 HAVING count(*) >= 2)),
  (SELECT count(*) AS events, {r('median(ended) AS half_life_median', 'quantile_cont(ended, 0.75) AS half_life_p75')} FROM walk WHERE ended IS NOT NULL)""")
def divergence_summary(spark, d):
    """A19."""
    return D.divergence_summary(D.pair_table(aligned(spark, d)))


LAGS = """, mv AS (SELECT *, pm - lag(pm) OVER w AS dp, k - lag(k) OVER w AS dk, count(*) OVER (PARTITION BY pm_id, k_id) AS days FROM al WINDOW w AS (PARTITION BY pm_id, k_id ORDER BY day)),
  ll AS (SELECT pm_id, k_id, days, lag, dp AS x, CASE lag WHEN -2 THEN b2 WHEN -1 THEN b1 WHEN 0 THEN dk WHEN 1 THEN f1 ELSE f2 END AS y FROM
    (SELECT *, lag(dk, 2) OVER w AS b2, lag(dk, 1) OVER w AS b1, lead(dk, 1) OVER w AS f1, lead(dk, 2) OVER w AS f2 FROM mv WINDOW w AS (PARTITION BY pm_id, k_id ORDER BY day)), (VALUES (-2), (-1), (0), (1), (2)) v(lag)),
  co AS (SELECT pm_id, k_id, days, lag, CASE WHEN count(x) FILTER (y IS NOT NULL) >= 3 AND stddev_pop(x) FILTER (y IS NOT NULL) >= 1e-12 AND stddev_pop(y) FILTER (x IS NOT NULL) >= 1e-12
     THEN covar_pop(x, y) / (stddev_pop(x) FILTER (y IS NOT NULL) * stddev_pop(y) FILTER (x IS NOT NULL)) END AS corr FROM ll GROUP BY 1, 2, 3, 4)"""


@query(W.with_views("al", LAGS) + f" SELECT pm_id, k_id, lag, {r('corr')} FROM co")
def lead_lag_pairs(spark, d):
    """W10."""
    return D.lead_lag(aligned(spark, d))


@query(W.with_views("al", LAGS) + f" SELECT lag, {r('avg(corr) AS mean_corr')}, count(corr) AS pairs FROM co WHERE days >= 8 GROUP BY lag")
def lead_lag_summary(spark, d):
    """A20."""
    return D.lead_lag_summary(aligned(spark, d), least_days=8)


@query(W.with_views("al", "SELECT greatest(0, least(39, floor((spread + 100) / 5)))::INT AS bin, count(*) AS n FROM sp GROUP BY 1"))
def spread_histogram(spark, d):
    """The data of the figure."""
    return D.histogram(aligned(spark, d))


def _case_twin(rules: tuple[tuple[str, str, str], ...], select: str = "SELECT * FROM") -> str:
    """Rule by rule: the first pair that no rule before took; select reads these rows."""
    out = W.with_views("al", """, pt AS (SELECT pm_id, k_id, count(*) AS n_days, avg(abs(spread)) AS mean_abs, max(abs(spread)) AS max_abs, any_value(basis_risk) AS basis_risk
    FROM sp JOIN (SELECT pm_id, k_id, basis_risk FROM pa) USING (pm_id, k_id) GROUP BY 1, 2 HAVING count(*) >= 2)""").rstrip()
    for i, (name, predicate, column) in enumerate(rules):
        before = "".join(f" AND (pm_id, k_id) NOT IN (SELECT (pm_id, k_id) FROM c{j})" for j in range(i))
        out += f",\n c{i} AS (SELECT '{name}' AS case_name, pm_id, k_id FROM pt WHERE {predicate}{before} ORDER BY {column} DESC, pm_id, k_id LIMIT 1)"
    return out + f"\n{select} (" + " UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(len(rules))) + ")"


_CASES = D.case_rules(least_days=5, long_days=12)


@query(_case_twin(_CASES))
def case_studies(spark, d):
    """T5."""
    per = D.pair_table(aligned(spark, d)).join(W.pairs(spark, d).select("pm_id", "k_id", "basis_risk"), ["pm_id", "k_id"])
    return D.case_studies(per, _CASES)


@query(_case_twin(_CASES, f"SELECT case_name, pm_id, k_id, day, {r('pm', 'k')} FROM al JOIN") + " USING (pm_id, k_id)")
def case_series(spark, d):
    """The data of the case studies' figures."""
    return aligned(spark, d).join(F.broadcast(case_studies(spark, d)), ["pm_id", "k_id"]).select("case_name", "pm_id", "k_id", "day", "pm", "k")


# --- backtest -------------------------------------------------------------------------------------------------------

FEE = "CASE lower(category) WHEN 'crypto' THEN 0.07 WHEN 'politics' THEN 0.04 ELSE 0.05 END"
TRADES = f""", cd AS (SELECT *, abs(pm - lag(pm) OVER (PARTITION BY pm_id, k_id ORDER BY day)) <= 0.25 AS calm FROM td),
  en AS (SELECT *, least(pm + slippage / 100, 1.0) AS y1, least(1 - pm + slippage / 100, 1.0) AS n1, {FEE} AS fee FROM cd, (VALUES (0.0::DOUBLE), (1.0), (2.0), (3.0)) s(slippage) WHERE calm),
  ct AS (SELECT *, y1 + fee * y1 * (1 - y1) + (1 - k_bid) + 0.07::DOUBLE * (1 - k_bid) * (1 - (1 - k_bid)) AS c1, k_ask + 0.07::DOUBLE * k_ask * (1 - k_ask) + n1 + fee * n1 * (1 - n1) AS c2 FROM en),
  fr AS (SELECT *, row_number() OVER (PARTITION BY pm_id, k_id, slippage ORDER BY day) AS rn FROM ct WHERE 1 - least(c1, c2) > 0),
  tr AS (SELECT pm_id, k_id, slippage, day AS entry_day, CASE WHEN c1 <= c2 THEN 'pm_yes' ELSE 'k_yes' END AS direction, least(c1, c2) AS cost, 1 - least(c1, c2) AS edge, greatest(1, date_diff('day', day, resolve_day))::INT AS days_held,
     (1 - least(c1, c2)) / least(c1, c2) * 365 / greatest(1, date_diff('day', day, resolve_day)) AS annualized,
     (CASE WHEN c1 <= c2 THEN (pm_outcome = 'YES')::INT + (k_outcome = 'NO')::INT ELSE (k_outcome = 'YES')::INT + (pm_outcome = 'NO')::INT END)::DOUBLE AS payout FROM fr WHERE rn = 1)"""


def traded(spark, d):
    days = BT.tradable_days(W.pairs(spark, d), W.daily(spark, d, "pm"), W.daily_quotes(spark, d))
    return days, BT.run_backtest(days)


@query(W.with_views("td", TRADES) + f" SELECT pm_id, k_id, slippage, entry_day, direction, {r('cost', 'edge')}, days_held, {r('annualized')}, payout, {r('payout - cost AS pnl')} FROM tr")
def backtest_trades(spark, d):
    """B1-B7, W8, W11, J8."""
    return traded(spark, d)[1]


@query(W.with_views("td", TRADES) + f""" SELECT slippage, count(*) AS opportunities, {r('avg(edge) AS mean_edge', 'median(edge) AS median_edge', 'sum(edge) AS theoretical_pnl', 'sum(payout - cost) AS realized_pnl')},
  count_if(payout = 1)::BIGINT AS paying_exactly_1, {r('median(days_held) AS median_days_held', 'median(annualized) AS median_annualized')}, (SELECT count(*) FROM (SELECT DISTINCT pm_id, k_id FROM td)) AS tradable_pairs FROM tr GROUP BY slippage""")
def backtest_summary(spark, d):
    """A21, B6."""
    days, trades = traded(spark, d)
    return BT.backtest_summary(trades, days)


# --- books ----------------------------------------------------------------------------------------------------------


def shots(spark, d):
    return B.snapshots(W.books(spark, d))


VWAPS = ", ".join(f"max(vwap) FILTER (side = 'ask' AND n = {n}) AS vwap_{n}" for n in B.SIZES)


@query(W.with_views("bk", f"""SELECT platform, market_id, ts, {r('best_bid', 'best_ask', 'vwap_50', 'vwap_200', 'vwap_1000', 'bid_depth', 'ask_depth')} FROM bs
  LEFT JOIN (SELECT platform, market_id, {VWAPS} FROM vw GROUP BY 1, 2) USING (platform, market_id)"""))
def book_snapshots(spark, d):
    """B8, B9, B14, P17, S11."""
    return shots(spark, d)


@query(W.with_views("bk", f"SELECT platform, count(*) AS books, {r(*(f'avg((vwap_{n} - best_ask) * 100) AS cost_{n}' for n in B.SIZES))} FROM bs LEFT JOIN (SELECT platform, market_id, {VWAPS} FROM vw GROUP BY 1, 2) USING (platform, market_id) WHERE best_ask IS NOT NULL GROUP BY 1"))
def depth_cost(spark, d):
    """A22, B11."""
    return B.depth_cost(shots(spark, d))


@query(W.with_views("bk", f"""SELECT platform, CASE WHEN ask_depth <= q[1] THEN 'thin' WHEN ask_depth <= q[2] THEN 'middle' ELSE 'deep' END AS band, count(*) AS books, {r('median(ask_depth) AS median_depth', 'median(slip) AS median_slip')}
  FROM (SELECT *, quantile_cont(ask_depth, [0.25, 0.75]) OVER (PARTITION BY platform) AS q, count(*) OVER (PARTITION BY platform) AS c FROM
    (SELECT platform, ask_depth, (vwap - best_ask) * 100 AS slip FROM bs JOIN vw USING (platform, market_id) WHERE side = 'ask' AND n = 200 AND vwap IS NOT NULL AND ask_depth > 0)) WHERE c >= 12 GROUP BY 1, 2"""))
def depth_quartiles(spark, d):
    """A23."""
    return B.depth_quartiles(shots(spark, d))


def signals(spark, d):
    b = W.books(spark, d)
    one = b.where("platform = 'pm'").select(F.col("market_id").alias("pm_id"), "ts", F.col("bids").alias("pm_bids"), F.col("asks").alias("pm_asks"))
    two = b.where("platform = 'k'").select(F.col("market_id").alias("k_id"), F.col("bids").alias("k_bids"), F.col("asks").alias("k_asks"))
    both = one.join(two, F.col("pm_id") == F.col("k_id")).withColumn("category", F.when(F.col("pm_id").cast("long") % 2 == 0, "crypto").otherwise("politics"))
    return B.evaluate(both)


def _cost(n: str) -> str:
    return f"""CASE WHEN a{n} IS NULL THEN b{n} WHEN b{n} IS NULL THEN a{n} ELSE least(a{n}, b{n}) END"""


_V = ", ".join(f"max(vwap) FILTER (side = '{s}' AND n = {n}) AS {s}{n}" for s in ("ask", "no") for n in B.SIZES)
_ALL = lambda y, n, fy, fn: f"({y} + {fy} * {y} * (1 - {y}) + {n} + {fn} * {n} * (1 - {n}))"
SIGNALS = f""", wv AS (SELECT platform, market_id, best_bid, best_ask, {_V} FROM bs LEFT JOIN vw USING (platform, market_id) GROUP BY 1, 2, 3, 4),
  jp AS (SELECT p.market_id AS pm_id, k.market_id AS k_id, CASE WHEN p.market_id::BIGINT % 2 = 0 THEN 0.07::DOUBLE ELSE 0.04::DOUBLE END AS fee, p.best_ask AS pa0, 1 - p.best_bid AS pn0, k.best_ask AS ka0, 1 - k.best_bid AS kn0,
    {', '.join(f'p.ask{n} AS pa{n}, p.no{n} AS pn{n}, k.ask{n} AS ka{n}, k.no{n} AS kn{n}' for n in B.SIZES)} FROM wv p JOIN wv k ON p.market_id = k.market_id AND p.platform = 'pm' AND k.platform = 'k'),
  ab AS (SELECT *, {', '.join(f"{_ALL(f'pa{n}', f'kn{n}', 'fee', '0.07::DOUBLE')} AS a{n}, {_ALL(f'ka{n}', f'pn{n}', '0.07::DOUBLE', 'fee')} AS b{n}" for n in (0, *B.SIZES))} FROM jp),
  sg AS (SELECT pm_id, k_id, 1700000000::BIGINT AS ts, CASE WHEN b0 IS NOT NULL AND (a0 IS NULL OR b0 < a0) THEN 'k_yes' ELSE 'pm_yes' END AS direction, {_cost('0')} AS touch_cost, 1 - {_cost('0')} AS touch_edge,
    {', '.join(f'{_cost(str(n))} AS exec_cost_{n}, 1 - {_cost(str(n))} AS exec_edge_{n}' for n in B.SIZES)}, pa0 AS pm_best_ask, 1 - pn0 AS pm_best_bid, ka0 AS k_best_ask, 1 - kn0 AS k_best_bid FROM ab)"""
_SIGNAL_COLUMNS = ["touch_cost", "touch_edge", *(f"exec_{k}_{n}" for n in B.SIZES for k in ("cost", "edge")), "pm_best_ask", "pm_best_bid", "k_best_ask", "k_best_bid"]


@query(W.with_views("bk", SIGNALS) + f" SELECT pm_id, k_id, ts, direction, {r(*_SIGNAL_COLUMNS)} FROM sg")
def paper_signals(spark, d):
    """B10, B12, B13."""
    return signals(spark, d)


@query(W.with_views("bk", SIGNALS) + f""" SELECT view, count(*) AS signals, coalesce(count_if(edge > 0), 0)::BIGINT AS positive, {r('median(edge) AS median_edge')}, coalesce(count_if(edge IS NULL), 0)::BIGINT AS unfillable
  FROM (SELECT 'touch' AS view, touch_edge AS edge FROM sg {' '.join(f"UNION ALL SELECT '{n}', exec_edge_{n} FROM sg" for n in B.SIZES)}) GROUP BY 1""")
def signal_summary(spark, d):
    """A24."""
    return B.signal_summary(signals(spark, d))


@query(W.with_views("bk", SIGNALS) + f""" SELECT count(*) AS signals, {r('median(touch_edge - exec_edge_200) AS median_loss', 'avg(touch_edge - exec_edge_200) AS mean_loss')}, coalesce(count_if(touch_edge > 0 AND exec_edge_200 <= 0), 0)::BIGINT AS turned
  FROM sg WHERE touch_edge IS NOT NULL AND exec_edge_200 IS NOT NULL""")
def edge_decay(spark, d):
    """A25."""
    return B.edge_decay(signals(spark, d))


SETTLED = """, sl AS (SELECT sg.*, a.outcome AS pm_outcome, b.outcome AS k_outcome, CASE WHEN direction = 'pm_yes' THEN (a.outcome = 'YES')::INT::DOUBLE + (b.outcome = 'NO')::INT ELSE (b.outcome = 'YES')::INT::DOUBLE + (a.outcome = 'NO')::INT END AS payout
  FROM sg JOIN em a ON a.platform = 'pm' AND a.market_id = pm_id AND a.outcome IS NOT NULL JOIN em b ON b.platform = 'k' AND b.market_id = k_id AND b.outcome IS NOT NULL)"""


@query(W.with_views("bk em", SIGNALS + SETTLED) + f" SELECT pm_id, k_id, direction, pm_outcome, k_outcome, payout, {r('payout - touch_cost AS pnl')} FROM sl")
def settled_signals(spark, d):
    """D7, J6."""
    return B.settle(signals(spark, d), W.event_markets(spark, d)).select("pm_id", "k_id", "direction", "pm_outcome", "k_outcome", "payout", "pnl")


@query(W.with_views("bk em", SIGNALS + SETTLED) + f" SELECT count(*) AS settled, count_if(payout = 1)::BIGINT AS paid_1, count_if(payout <> 1)::BIGINT AS paid_other, {r('sum(payout - touch_cost) AS pnl')} FROM sl")
def settled_summary(spark, d):
    """A26."""
    return B.settled_summary(B.settle(signals(spark, d), W.event_markets(spark, d)))


# --- report queries -------------------------------------------------------------------------------------------------


def headline(spark, d):
    return Q.headline_markets(W.order_markets(spark, d))


@query(W.with_views("hm", f"SELECT platform, market_id, outcome, {r('lifetime_hours')} FROM hm"))
def headline_markets(spark, d):
    """F1."""
    return headline(spark, d).select("platform", "market_id", "outcome", "lifetime_hours")


@query(W.with_views("hm", f"SELECT platform, count(*) AS markets, count_if(outcome = 'YES')::BIGINT AS yes_count, {r('avg((outcome = $$YES$$)::INT::DOUBLE) AS yes_share')} FROM hm GROUP BY 1"))
def base_rates(spark, d):
    """A1."""
    return Q.base_rates(headline(spark, d))


@query(W.with_views("hm", "SELECT platform, strftime(close_ts, '%Y-%m') AS month, count(*) AS markets, (sum(count(*)) OVER (PARTITION BY platform ORDER BY strftime(close_ts, '%Y-%m')))::BIGINT AS cumulative FROM hm GROUP BY 1, 2"))
def monthly_counts(spark, d):
    """A2, W1."""
    return Q.monthly_counts(headline(spark, d))


@query(W.with_views("hm", f"SELECT platform, coalesce(category, '(none)') AS category, count(*) AS markets, {r('100.0 * count(*) / sum(count(*)) OVER (PARTITION BY platform) AS pct_of_platform')} FROM hm GROUP BY platform, coalesce(category, '(none)')"))
def category_shares(spark, d):
    """W2."""
    return Q.category_shares(headline(spark, d))


EVENT_MARKETS = "em2 AS (SELECT *, (anchor - opened) / 86400.0 AS life FROM em)"


def timed_markets(spark, d):
    m = W.event_markets(spark, d)
    return m.withColumn("open_ts", F.timestamp_seconds("opened")).withColumn("close_ts", F.timestamp_seconds("anchor"))


@query(W.with_views("pr em", f", {EVENT_MARKETS} SELECT platform, market_id, count(*) AS price_days, {r('any_value(life) AS lifetime_days', 'least(1.0, count(*) / greatest(any_value(life), 1.0)) AS coverage')} FROM pr JOIN em2 USING (platform, market_id) GROUP BY 1, 2"))
def coverage_per_market(spark, d):
    """A8, J1."""
    return Q.coverage_per_market(W.prices(spark, d), timed_markets(spark, d))


@query(W.with_views("pr em", f"""SELECT platform, {r('floor(prob * 10 + 0.5) / 10 AS price_bucket')}, count(*) AS markets, {r('avg((outcome = $$YES$$)::INT::DOUBLE) AS empirical_yes_rate')}
  FROM (SELECT platform, market_id, coalesce(price, (bid + ask) / 2) AS prob, row_number() OVER (PARTITION BY platform, market_id ORDER BY ts DESC, coalesce(price, (bid + ask) / 2) DESC NULLS LAST) AS rn FROM pr)
  JOIN (SELECT platform, market_id, outcome FROM em WHERE outcome IS NOT NULL AND anchor - opened >= 86400) USING (platform, market_id) WHERE rn = 1 AND prob IS NOT NULL GROUP BY 1, 2"""))
def last_price_calibration(spark, d):
    """J2, W3, F3."""
    return Q.last_price_calibration(W.prices(spark, d), Q.headline_markets(timed_markets(spark, d)))


@query(W.with_views("hm", f"SELECT platform, ntile(3) OVER (PARTITION BY platform ORDER BY volume, market_id)::INT AS volume_tercile, market_id, {r('volume')} FROM hm WHERE volume IS NOT NULL"))
def volume_terciles(spark, d):
    """W4."""
    return Q.volume_terciles(headline(spark, d))


@query(W.with_views("om", "SELECT platform, count(*) AS total, count_if(outcome IS NOT NULL AND epoch(close_ts) - epoch(open_ts) >= 86400)::BIGINT AS headline, count_if(outcome IS NULL)::BIGINT AS no_outcome, count_if(outcome IS NOT NULL AND epoch(close_ts) - epoch(open_ts) < 86400)::BIGINT AS excluded_short FROM om GROUP BY 1"))
def market_counts(spark, d):
    """A3."""
    return Q.market_counts(W.order_markets(spark, d))


@query(W.with_views("hm", "SELECT platform, min(close_ts)::DATE AS first_close, max(close_ts)::DATE AS last_close FROM hm GROUP BY 1"))
def date_coverage(spark, d):
    """A4."""
    out = Q.date_coverage(headline(spark, d))
    return out.select("platform", F.to_date("first_close").alias("first_close"), F.to_date("last_close").alias("last_close"))


@query(W.with_views("hm", "SELECT platform, outcome, count(*) AS n FROM hm GROUP BY 1, 2"))
def outcome_distribution(spark, d):
    """A5."""
    return Q.outcome_distribution(headline(spark, d))


@query(W.with_views("hm", "SELECT platform, category, n, rn::INT AS at FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY n DESC, category) AS rn FROM (SELECT platform, coalesce(category, '(none)') AS category, count(*) AS n FROM hm GROUP BY 1, 2)) WHERE rn <= 3"))
def top_categories(spark, d):
    """A6, T1."""
    return Q.top_categories(headline(spark, d), 3)


@query(W.with_views("pr em", f""", {EVENT_MARKETS} SELECT platform, sum(n)::BIGINT AS n_rows, count(*) AS markets, sum(missing)::BIGINT AS missing, {r('avg(CASE WHEN life <= 0 THEN 1.0 ELSE least(1.0, n / life) END) AS mean_coverage', 'round(sum(missing) * 100.0 / sum(n), 2) AS pct_missing')}
  FROM (SELECT platform, market_id, count(*) AS n, count_if(price IS NULL) AS missing FROM pr GROUP BY 1, 2) JOIN em2 USING (platform, market_id) GROUP BY 1"""))
def price_stats(spark, d):
    """A7, F8, F9."""
    return Q.price_stats(W.prices(spark, d), timed_markets(spark, d))


# --- matching -------------------------------------------------------------------------------------------------------


def title_markets(spark, d):
    """Parts as markets of both venues: even keys on ``pm``, odd ones on ``k``; titles carry a number and a class."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    title = F.concat_ws(" ", F.lit("Will"), F.initcap("p_name"), F.lower("p_type"), F.lit("be over"), ((k % 7) / 2.0).cast("string"), F.when(k % 5 == 0, "Highest").when(k % 9 == 0, "1st Half!").otherwise("(2024)"))
    venue = F.when(k % 2 == 0, "pm").otherwise("k")
    return p.select(
        venue.alias("platform"),
        F.concat(F.when(k % 2 == 1, F.concat(F.lit("KX"), F.upper(F.split("p_name", " ")[1]), F.lit("-"))).otherwise(""), k.cast("string")).alias("market_id"),
        title.alias("title"),
        F.when(venue == "pm", F.when(k % 4 == 0, "Soccer").otherwise("Crypto")).otherwise(F.when(k % 4 == 1, "Sports").otherwise("Crypto")).alias("category"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.floor(k / 2) % 120).cast("int")).alias("close_ts"),
        # of the second venue's records some say more than the title, some what it says already
        F.when((venue == "k") & (k % 3 == 0), F.to_json(F.struct(F.lit("Above: 3 Points").alias("yes_sub_title"))))
        .when((venue == "k") & (k % 3 == 1), F.to_json(F.struct(F.upper("p_type").alias("yes_sub_title"))))
        .otherwise("{}").alias("raw_json"),
        F.upper(F.split("p_name", " ")[1]).alias("series"),
    )


TITLES = """tm AS (SELECT p_partkey AS k, p_partkey % 2 = 0 AS pm, CASE WHEN p_partkey % 2 = 1 THEN 'KX' || upper(split_part(p_name, ' ', 2)) || '-' ELSE '' END || p_partkey AS market_id,
  trim(regexp_replace(regexp_replace(lower('Will ' || p_name || ' ' || p_type || ' be over ' || ((p_partkey % 7) / 2.0)::DOUBLE::VARCHAR || ' ' || CASE WHEN p_partkey % 5 = 0 THEN 'Highest' WHEN p_partkey % 9 = 0 THEN '1st Half!' ELSE '(2024)' END || CASE WHEN p_partkey % 6 = 3 THEN ' Above: 3 Points' ELSE '' END), '[^a-z0-9 .+-]+', ' ', 'g'), ' +', ' ', 'g')) AS text,
  DATE '2024-01-01' + (p_partkey // 2 % 120)::INT AS close_date, CASE WHEN p_partkey % 4 IN (0, 1) THEN 'sports' ELSE 'crypto' END AS bucket FROM part)"""


def sides(spark, d):
    m = M.match_inputs(title_markets(spark, d))
    return m.where("platform = 'pm'"), m.where("platform = 'k'")


@query(f"WITH {TITLES} SELECT CASE WHEN pm THEN 'pm' ELSE 'k' END AS platform, market_id, text, close_date, bucket FROM tm")
def match_inputs(spark, d):
    """M1, M2, M3, M12."""
    return M.match_inputs(title_markets(spark, d)).drop("series")


@query(f"WITH {TITLES} SELECT market_id, array_to_string(list_transform(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '\\d+(?:\\.\\d+)?'), lambda x: x::DOUBLE), lambda x: NOT (x = floor(x) AND x BETWEEN 1900 AND 2100)))), lambda x: round(x * 10)::INT::VARCHAR), ',') AS numbers, "
       "CASE WHEN text LIKE '%highest%' THEN 'max' END AS extreme, CASE WHEN text LIKE '%1st half%' THEN '1st' END AS half FROM tm")
def title_classes(spark, d):
    """M4, M5."""
    t = M.match_inputs(title_markets(spark, d))
    text = F.transform(titles.numbers(F.col("text")), lambda x: F.round(x * 10).cast("int").cast("string"))
    return t.select("market_id", F.array_join(text, ",").alias("numbers"), titles.extreme_class(F.col("text")).alias("extreme"), titles.half_class(F.col("text")).alias("half"))


@query(f"WITH {TITLES} SELECT p.market_id AS pm_id, k.market_id AS k_id FROM tm p JOIN tm k ON p.pm AND NOT k.pm AND p.bucket = k.bucket AND abs(date_diff('day', p.close_date, k.close_date)) <= 3")
def blocked_pairs(spark, d):
    """J9."""
    return M.pair_ids(*sides(spark, d))


@query(f"""WITH {TITLES}, nm AS (SELECT *, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '\\d+(?:\\.\\d+)?'), lambda x: x::DOUBLE), lambda x: x <> 2024))) AS nums, text LIKE '%highest%' AS hi, text LIKE '%1st half%' AS hf FROM tm)
  SELECT p.market_id AS pm_id, k.market_id AS k_id FROM nm p JOIN nm k ON p.pm AND NOT k.pm AND p.bucket = k.bucket AND abs(date_diff('day', p.close_date, k.close_date)) <= CASE p.bucket WHEN 'sports' THEN 1 ELSE 3 END
  WHERE p.nums = k.nums""")
def guarded_pairs(spark, d):
    """M6, M7, M10."""
    return M.guarded(M.blocked_pairs(*sides(spark, d))).select("pm_id", "k_id")


def candidates(spark, d):
    return M.build_candidates(*sides(spark, d), threshold=60.0)


# Common subsequences by rows of bits, one letter of the right string per round: a bit is 0 where the letters of the left string up to it gain one.
LETTERS = """ls AS (SELECT DISTINCT a, b FROM ({pairs}) WHERE a <> '' AND b <> ''), li AS (SELECT row_number() OVER (ORDER BY a, b) AS id, a, b FROM ls),
  mk AS (SELECT a, c, sum(bit) AS bits FROM (SELECT a, a[i] AS c, (2::HUGEINT ** (i - 1))::HUGEINT AS bit FROM (SELECT a, unnest(range(1, length(a) + 1)) AS i FROM (SELECT DISTINCT a FROM ls))) GROUP BY 1, 2),
  wk(id, i, bits) AS (
    SELECT id, 0::BIGINT, (2::HUGEINT ** length(a))::HUGEINT - 1 FROM li
    UNION ALL SELECT wk.id, wk.i + 1, CASE WHEN mk.bits IS NULL THEN wk.bits ELSE ((wk.bits + (wk.bits & mk.bits)) | (wk.bits - (wk.bits & mk.bits))) & ((2::HUGEINT ** length(li.a))::HUGEINT - 1) END
    FROM wk JOIN li ON li.id = wk.id LEFT JOIN mk ON mk.a = li.a AND mk.c = li.b[wk.i + 1] WHERE wk.i < length(li.b)),
  lc AS (SELECT a, b, length(a) - bit_count(bits) AS kept FROM wk JOIN li ON li.id = wk.id AND wk.i = length(li.b))"""

_CANDIDATES = f"""WITH RECURSIVE {TITLES},
  nm AS (SELECT *, list_sort(list_distinct(string_split(text, ' '))) AS ws, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '\\d+(?:\\.\\d+)?'), lambda x: x::DOUBLE), lambda x: x <> 2024))) AS nums FROM tm),
  bp AS (SELECT p.market_id AS pm_id, k.market_id AS k_id, p.nums = k.nums AND abs(date_diff('day', p.close_date, k.close_date)) <= CASE p.bucket WHEN 'sports' THEN 1 ELSE 3 END AS fits,
      array_to_string(list_sort(list_intersect(p.ws, k.ws)), ' ') AS sh, array_to_string(list_filter(p.ws, lambda x: NOT list_contains(k.ws, x)), ' ') AS a, array_to_string(list_filter(k.ws, lambda x: NOT list_contains(p.ws, x)), ' ') AS b
    FROM nm p JOIN nm k ON p.pm AND NOT k.pm AND p.bucket = k.bucket AND abs(date_diff('day', p.close_date, k.close_date)) <= 3),
  {LETTERS.format(pairs="SELECT a, b FROM bp")},
  sc AS (SELECT pm_id, k_id, fits, CASE WHEN sh <> '' AND (a = '' OR b = '') THEN 100.0 ELSE greatest(
      200.0::DOUBLE * (CASE WHEN sh = '' THEN 0 ELSE length(sh) + 1 END + coalesce(kept, 0)) / (2 * CASE WHEN sh = '' THEN 0 ELSE length(sh) + 1 END + length(a) + length(b)),
      200.0::DOUBLE * length(sh) / (2 * length(sh) + 1 + least(length(a), length(b)))) END AS score FROM bp LEFT JOIN lc USING (a, b)),
  t8 AS (SELECT * FROM sc WHERE score >= 60 QUALIFY row_number() OVER (PARTITION BY k_id ORDER BY score DESC, pm_id) <= 8),
  bk AS (SELECT * FROM t8 WHERE fits QUALIFY row_number() OVER (PARTITION BY k_id ORDER BY score DESC, pm_id) = 1),
  cn AS (SELECT pm_id, k_id, score FROM bk QUALIFY row_number() OVER (PARTITION BY pm_id ORDER BY score DESC, k_id) = 1)"""


@query(f"{_CANDIDATES} SELECT pm_id, k_id, {r('score')} FROM cn")
def match_candidates(spark, d):
    """M8, M9, W13, T3."""
    return candidates(spark, d)


@query(f"{_CANDIDATES} SELECT * FROM (SELECT split_part(k_id, '-', 1) AS series, count(*) AS n FROM cn GROUP BY 1) WHERE n >= 2 ORDER BY n DESC, series LIMIT 250")
def productive_series(spark, d):
    """A27, T2, over the candidates."""
    return M.productive_series(candidates(spark, d))


@query(f"""{_CANDIDATES} SELECT pm_id, k_id, {r('score')}, 'token_set' AS method, pm_id::BIGINT % 3 = 0 AS verified, CASE WHEN pm_id::BIGINT % 3 = 0 THEN 'inverse' END AS orientation, pm_id::BIGINT % 3 = 0 AS basis_risk FROM cn
  UNION ALL SELECT 'gone', 'verified', 50.0, 'old', true, 'inverse', true""")
def matching_run(spark, d):
    """Inputs, candidates, and the table of matches in which they replace what wasn't verified."""
    found = candidates(spark, d)
    old = found.where(F.col("pm_id").cast("long") % 3 == 0).select("pm_id", "k_id", F.lit(True).alias("verified"))
    old = old.union(spark.createDataFrame([("gone", "verified", True), ("gone", "unverified", False)], "pm_id string, k_id string, verified boolean"))
    old = old.select("*", F.lit("inverse").alias("orientation"), F.lit(True).alias("basis_risk"), F.lit(50.0).alias("score"), F.lit("old").alias("method"))
    return M.replace_candidates(old, found)


# titles that take each branch of the guards
SAMPLES = (
    "highest temperature in new york on may 3", "lowest temperature in chicago on may 3", "max and min temp in miami", "high temp in los angeles above 70", "will it rain in denver on may 3",
    "lakers vs celtics", "lakers vs celtics winner", "will the lakers win", "first half points over 50.5", "2nd half points over 50.5", "1st half and second half points over 50.5", "coin toss heads", "coin toss heads in 2025",
    "over 50.5 points", "lakers vs celtics 3", "fed cuts rates by 25 or 50",
)
SERIES = ("KXHIGHNY", "KXLOWTCHI", "KXHIGHTEMPMIA", "KXLOWCHI", "KXHIGHLAX", "KXRAINDEN", "KXDEN")


def sample_pairs(spark, d):
    n = len(SAMPLES)
    pick = lambda values, i: F.get(F.array(*(F.lit(v) for v in values)), i.cast("int"))
    p = F.col("p_partkey")
    return table(spark, d, "part").select(p.cast("string").alias("pair"), pick(SAMPLES, p % n).alias("a"), pick(SAMPLES, F.floor(p / n) % n).alias("b"), pick(SERIES, p % len(SERIES)).alias("series"))


_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_SIDE = "SELECT *, {}".format(
    ", ".join(
        f"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({x}, '\\d+(?:\\.\\d+)?'), lambda x: x::DOUBLE), lambda x: NOT (x = floor(x) AND x BETWEEN 1900 AND 2100)))) AS n{x}, "
        f"regexp_matches({x}, '\\b(highest|maximum|max|high temp)\\b') AS hi{x}, regexp_matches({x}, '\\b(lowest|minimum|min|low temp)\\b') AS lo{x}, "
        f"CASE WHEN regexp_matches({x}, '\\b(1st|first) half\\b') THEN '1st' WHEN regexp_matches({x}, '\\b(2nd|second) half\\b') THEN '2nd' END AS hf{x}, list_contains(string_split({x}, ' '), 'toss') AS ts{x}, "
        f"regexp_matches({x}, '^[a-z0-9 .]+ vs [a-z0-9 .]+$') AS vs{x}, regexp_matches({x}, '\\b(win|wins|winner|beat|beats|moneyline)\\b') AS wn{x}"
        for x in ("a", "b")
    )
)


@query(f"""WITH sm AS (SELECT p_partkey::VARCHAR AS pair, {_LIST(SAMPLES)}[p_partkey % 16 + 1] AS a, {_LIST(SAMPLES)}[p_partkey // 16 % 16 + 1] AS b, {_LIST(SERIES)}[p_partkey % 7 + 1] AS series FROM part),
  sd AS ({_SIDE} FROM sm), ex AS (SELECT *, CASE WHEN hia AND NOT loa THEN 'max' WHEN loa AND NOT hia THEN 'min' END AS xa, CASE WHEN hib AND NOT lob THEN 'max' WHEN lob AND NOT hib THEN 'min' END AS xb FROM sd)
  SELECT pair, xa AS extreme, hfa AS half, na = nb AND coalesce(xa = xb, true) AND coalesce(hfa = hfb, true) AND tsa = tsb AND NOT (vsa AND len(na) = 0 AND NOT wnb) AND NOT (vsb AND len(nb) = 0 AND NOT wna) AS compatible,
    coalesce(contains(a, CASE series WHEN 'KXHIGHNY' THEN 'new york' WHEN 'KXHIGHTEMPMIA' THEN 'miami' WHEN 'KXLOWCHI' THEN 'chicago' WHEN 'KXHIGHLAX' THEN 'los angeles' WHEN 'KXDEN' THEN 'denver' END), false) AS city FROM ex""")
def title_guards(spark, d):
    """M4, M5, M6, M7: each branch."""
    s = sample_pairs(spark, d)
    return s.select(
        "pair",
        titles.extreme_class(F.col("a")).alias("extreme"),
        titles.half_class(F.col("a")).alias("half"),
        titles.compatible(F.col("a"), F.col("b")).alias("compatible"),
        titles.weather_city_ok(F.col("a"), F.col("series")).alias("city"),
    )


@query(W.with_views("om", "SELECT platform, market_id FROM om WHERE close_ts >= TIMESTAMP '1995-01-01' AND close_ts < TIMESTAMP '1995-07-01'"))
def closing_between(spark, d):
    """F4."""
    return M.closing_between(W.order_markets(spark, d), "1995-01-01", "1995-07-01").select("platform", "market_id")


_PAIRED = "SELECT user_id::VARCHAR AS pm_id, user_id::VARCHAR AS k_id, user_id % 100 / 1.0::DOUBLE AS score FROM (SELECT DISTINCT user_id FROM events)"


def scored_users(spark, d):
    u = table(spark, d, "events").select("user_id").distinct()
    return u.select(F.col("user_id").cast("string").alias("pm_id"), F.col("user_id").cast("string").alias("k_id"), (F.col("user_id") % 100).cast("double").alias("score"))


@query(f"WITH c AS ({_PAIRED}), o AS (SELECT *, pm_id::BIGINT % 3 = 0 AS verified FROM c WHERE pm_id::BIGINT % 2 = 0), n AS (SELECT pm_id, k_id, score + 0.5 AS score FROM c WHERE pm_id::BIGINT % 5 <> 0) "
       "SELECT pm_id, k_id, coalesce(n.score, o.score) AS score, CASE WHEN n.score IS NOT NULL THEN 'token_set' ELSE 'old' END AS method, coalesce(o.verified, false) AS verified, CASE WHEN o.verified THEN 'same' END AS orientation, false AS basis_risk FROM n FULL JOIN (SELECT * FROM o WHERE verified) o USING (pm_id, k_id)")
def replaced_candidates(spark, d):
    """D5, M11."""
    c = scored_users(spark, d)
    user = F.col("pm_id").cast("long")
    old = c.where(user % 2 == 0).withColumns({"verified": user % 3 == 0, "orientation": F.lit("same"), "basis_risk": F.lit(False), "method": F.lit("old")})
    return M.replace_candidates(old, c.where(user % 5 != 0).withColumn("score", F.col("score") + 0.5))


@query(W.with_views("pr", f", c AS ({_PAIRED}) SELECT pm_id, k_id, score, (pm_id IN (SELECT market_id FROM pr WHERE platform = 'pm' AND price > 0.9)) AND (k_id IN (SELECT market_id FROM pr WHERE platform = 'k' AND price > 0.9)) AS both_priced FROM c"))
def both_priced(spark, d):
    """J14."""
    return M.with_both_priced(scored_users(spark, d), W.prices(spark, d).where("price > 0.9"))


@query(W.with_views("pr", f", c AS ({_PAIRED}) SELECT pm_id, k_id FROM c WHERE score >= 85 OR ((pm_id IN (SELECT market_id FROM pr WHERE platform = 'pm' AND price > 0.9)) AND (k_id IN (SELECT market_id FROM pr WHERE platform = 'k' AND price > 0.9)))"))
def for_review(spark, d):
    """F6."""
    return M.for_review(M.with_both_priced(scored_users(spark, d), W.prices(spark, d).where("price > 0.9"))).select("pm_id", "k_id")


@query(W.with_views("em", f", c AS ({_PAIRED}) SELECT pm_id, k_id, score, a.category AS pm_title, a.anchor AS pm_close, b.category AS k_title, b.anchor AS k_close FROM c JOIN em a ON a.platform = 'pm' AND a.market_id = pm_id JOIN em b ON b.platform = 'k' AND b.market_id = k_id"))
def enriched_candidates(spark, d):
    """J15."""
    m = W.event_markets(spark, d).select("platform", "market_id", F.col("category").alias("title"), F.col("anchor").alias("close_ts"))
    return M.enriched(scored_users(spark, d), m)


@query(f"WITH c AS ({_PAIRED}) SELECT pm_id, k_id, score, pm_id::BIGINT % 4 = 1 AND pm_id::BIGINT % 7 <> 0 OR pm_id::BIGINT % 5 = 0 AS verified, CASE WHEN pm_id::BIGINT % 4 = 1 AND pm_id::BIGINT % 7 <> 0 THEN CASE WHEN pm_id::BIGINT % 3 = 1 THEN 'inverse' ELSE 'same' END END AS orientation, pm_id::BIGINT % 4 = 1 AND pm_id::BIGINT % 7 <> 0 AND pm_id::BIGINT % 3 = 2 AS basis_risk FROM c")
def applied_verdicts(spark, d):
    """D6."""
    c, user = scored_users(spark, d), F.col("pm_id").cast("long")
    matches = c.withColumns({"verified": user % 5 == 0, "orientation": F.lit(None).cast("string"), "basis_risk": F.lit(False)})
    code = F.when(user % 7 == 0, "0").when(user % 3 == 1, "inv").when(user % 3 == 2, "br").otherwise("1")
    return V.apply_verdicts(matches, c.where(user % 4 == 1).select("pm_id", "k_id", code.alias("code")))


REVIEWED = ("KXWCGOAL", "KXEPLBTTS", "KXRT", "KXUCL", "KXHIGHNY", "KXNBAFINMVP", "KXOTHER", "KXANIMEBEST")


def review_pairs(spark, d):
    """Parts as pairs under review, series from the rule table and beyond; every rule holds for some and fails for others."""
    k = F.col("p_partkey")
    series = F.get(F.array(*(F.lit(s) for s in REVIEWED)), (k % 8).cast("int"))
    p = table(spark, d, "part")
    name, kind = F.split("p_name", " "), F.lower("p_type")
    return p.select(
        k.cast("string").alias("pm_id"),
        F.concat(series, F.lit("-"), k.cast("string")).alias("k_id"),
        series.alias("series"),
        F.when(k % 5 == 0, F.concat(F.lit("xq"), F.substring(name[0], 3, 20))).when(k % 3 == 0, name[1]).otherwise(F.concat(name[0], F.lit("é"))).alias("k_sub"),
        F.concat(F.lit("Award for "), F.col("p_name"), F.when(k % 9 == 0, F.concat(F.lit(" "), kind)).otherwise(""), F.lit("?")).alias("k_title"),
        F.concat(F.lit("If "), name[0], F.lit(" FC and "), F.when(k % 7 == 0, kind).otherwise(name[1]), F.lit(" United both score goals in the match")).alias("k_rules"),
        F.concat(F.when(k % 13 == 0, "Player: ").otherwise("Goal: "), F.col("p_name"), F.when((k % 4 == 0) | (k % 3 == 1), " Finals MVP").otherwise("")).alias("pm_title"),
        F.when(k % 10 == 0, "A cricket test series").when(k % 11 == 0, "An evening").otherwise("UEFA soccer").alias("pm_desc"),
        F.when(k % 6 == 0, F.array(name[0], name[1])).otherwise(F.array(F.lit("Yes"), F.lit("No"))).alias("pm_outcomes"),
        F.lit(0).alias("pm_leg"),
    )


_TOKENS = lambda x: f"list_filter(string_split(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN ({', '.join(repr(w) for w in V.STOP)}))"
_SPORTS = lambda x: "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(strip_accents({x})), '{w}')" for w in words) + f" THEN '{sport}' END" for sport, words in V.SPORT_WORDS.items()) + "], lambda z: z IS NOT NULL)"
REVIEW = f"""rp AS (SELECT p_partkey AS k, {_LIST(REVIEWED)}[p_partkey % 8 + 1] AS series, string_split(p_name, ' ') AS nm, lower(p_type) AS kd, p_name FROM part),
  rv AS (SELECT k, k::VARCHAR AS pm_id, series || '-' || k AS k_id, series, nm, CASE WHEN k % 5 = 0 THEN 'xq' || substr(nm[1], 3, 20) WHEN k % 3 = 0 THEN nm[2] ELSE nm[1] || 'é' END AS k_sub,
    'Award for ' || p_name || CASE WHEN k % 9 = 0 THEN ' ' || kd ELSE '' END || '?' AS k_title, 'If ' || nm[1] || ' FC and ' || CASE WHEN k % 7 = 0 THEN kd ELSE nm[2] END || ' United both score goals in the match' AS k_rules,
    CASE WHEN k % 13 = 0 THEN 'Player: ' ELSE 'Goal: ' END || p_name || CASE WHEN k % 4 = 0 OR k % 3 = 1 THEN ' Finals MVP' ELSE '' END AS pm_title,
    CASE WHEN k % 10 = 0 THEN 'A cricket test series' WHEN k % 11 = 0 THEN 'An evening' ELSE 'UEFA soccer' END AS pm_desc FROM rp),
  rt AS (SELECT *, {_TOKENS('pm_title')} || CASE WHEN k % 6 = 0 THEN {_TOKENS("nm[1] || ' ' || nm[2]")} ELSE {_TOKENS("'Yes No'")} END AS subject_hay, {_TOKENS("pm_title || ' ' || pm_desc")} AS fixture_hay,
    list_filter({_TOKENS('k_sub')}, lambda w: length(w) >= 3 AND NOT regexp_full_match(w, '\\d+')) AS telling,
    list_filter({_TOKENS('nm[1]')}, lambda w: length(w) >= 3) AS team_a, list_filter({_TOKENS("CASE WHEN k % 7 = 0 THEN string_split(k_rules, ' ')[5] ELSE nm[2] END")}, lambda w: length(w) >= 3) AS team_b FROM rv),
  wp AS (SELECT DISTINCT w AS a, unnest(hay) AS b FROM (SELECT unnest(telling) AS w, subject_hay AS hay FROM rt UNION ALL SELECT unnest(team_a), fixture_hay FROM rt UNION ALL SELECT unnest(team_b), fixture_hay FROM rt)),
  {LETTERS.format(pairs="SELECT a, b FROM wp")},
  nr AS (SELECT a, b FROM lc WHERE 200.0::DOUBLE * kept / (length(a) + length(b)) >= 85),
  nw AS (SELECT k, i, list_contains(list(coalesce(nr.a IS NOT NULL, false)), true) AS near FROM (SELECT k, i, telling[i] AS w, unnest(subject_hay) AS h FROM (SELECT *, unnest(range(1, len(telling) + 1)) AS i FROM rt)) LEFT JOIN nr ON nr.a = w AND nr.b = h GROUP BY 1, 2),
  sb AS (SELECT k, arg_max(near, i) AND avg(near::INT) >= 0.5 AS subject FROM nw GROUP BY 1),
  fx AS (SELECT k, bool_and(near) AS fixture FROM (SELECT k, team, bool_or(nr.a IS NOT NULL) AS near FROM
    (SELECT k, team, w, unnest(fixture_hay) AS h FROM (SELECT k, 1 AS team, fixture_hay, unnest(team_a) AS w FROM rt UNION ALL SELECT k, 2, fixture_hay, unnest(team_b) FROM rt)) LEFT JOIN nr ON nr.a = w AND nr.b = h GROUP BY 1, 2) GROUP BY 1),
  sp1 AS (SELECT *, {_SPORTS("pm_title || ' ' || pm_desc")} AS s1, {_SPORTS("k_title || ' ' || k_rules")} AS s2 FROM rt),
  jd AS (SELECT sp1.*, coalesce(subject, true) AS subject, coalesce(fixture, true) AS fixture, len(s1) > 0 AND len(s2) > 0 AND len(list_intersect(s1, s2)) = 0 AS conflict,
    CASE WHEN k % 6 <> 0 THEN 'na' WHEN list_contains({_TOKENS('k_sub')}, nm[1]) AND nm[1] <> nm[2] AND NOT list_contains({_TOKENS('k_sub')}, nm[2]) THEN 'same' WHEN list_contains({_TOKENS('k_sub')}, nm[2]) AND nm[1] <> nm[2] THEN 'inverse' ELSE 'unclear' END AS orient
    FROM sp1 LEFT JOIN sb USING (k) LEFT JOIN fx USING (k)),
  ck AS (SELECT *, (series <> 'KXNBAFINMVP' OR contains(lower(pm_title), 'finals mvp')) AND subject AND (series <> 'KXEPLBTTS' OR fixture) AND NOT conflict AS checked FROM jd),
  cd AS (SELECT pm_id, k_id, series, orient, CASE WHEN series = 'KXWCGOAL' AND NOT contains(lower(pm_title), 'goal') THEN '0' WHEN series = 'KXUCL' THEN '0' WHEN series = 'KXRT' THEN CASE WHEN checked THEN 'br' ELSE '0' END WHEN series = 'KXOTHER' THEN ''
      WHEN series = 'KXANIMEBEST' AND len(list_filter({_TOKENS("regexp_extract(lower(k_title), 'award for (.+?)\\??$', 1)")}, lambda w: NOT list_contains({_TOKENS('pm_title')}, w))) > 0 THEN '0'
      WHEN NOT checked THEN '0' WHEN orient = 'inverse' THEN 'inv' WHEN orient = 'unclear' THEN '' ELSE '1' END AS code FROM ck)"""


@query(f"WITH RECURSIVE {REVIEW} SELECT pm_id, k_id, code, CASE code WHEN 'inv' THEN 'inverse' WHEN '1' THEN CASE orient WHEN 'na' THEN 'same' ELSE orient END WHEN 'br' THEN CASE orient WHEN 'na' THEN 'same' ELSE orient END ELSE '' END AS oriented FROM cd")
def verification_codes(spark, d):
    """V1-V7, V9."""
    return V.decide(review_pairs(spark, d)).select("pm_id", "k_id", "code", "oriented")


@query(f"WITH RECURSIVE {REVIEW} SELECT series, code, count(*) AS n FROM cd GROUP BY 1, 2")
def verification_counts(spark, d):
    """A28."""
    return V.verdict_counts(V.decide(review_pairs(spark, d)))


@query(f"WITH RECURSIVE {REVIEW} SELECT pm_id, subject AS subject, fixture, conflict FROM jd")
def verification_checks(spark, d):
    """V1, V2, V3, V4, V5."""
    c = F.col
    return review_pairs(spark, d).select(
        "pm_id",
        V.subject_ok(c("k_sub"), c("pm_title"), c("pm_outcomes")).alias("subject"),
        V.fixture_ok(c("pm_title"), c("pm_desc"), c("k_rules")).alias("fixture"),
        V.sports_conflict(F.concat_ws(" ", "pm_title", "pm_desc"), F.concat_ws(" ", "k_title", "k_rules")).alias("conflict"),
    )


@query("""SELECT p_partkey::VARCHAR AS pm_id, p_partkey % 10 = 0 AS conflict FROM part""")
def sports_conflicts(spark, d):
    """V5."""
    cricket = F.when(F.col("pm_id").cast("long") % 10 == 0, "A cricket test series").otherwise("UEFA soccer")
    return review_pairs(spark, d).select("pm_id", V.sports_conflict(cricket, F.lit("goals in the Bundesliga")).alias("conflict"))


@query(f"WITH RECURSIVE {REVIEW} SELECT pm_id, orient AS orientation FROM jd")
def leg_orientation(spark, d):
    """V6."""
    return review_pairs(spark, d).select("pm_id", V.orientation(F.col("pm_outcomes"), F.col("pm_leg"), F.col("k_sub")).alias("orientation"))


@query("""SELECT p_partkey::VARCHAR AS pm_id, CASE WHEN p_partkey % 6 <> 0 THEN 'na' ELSE 'unclear' END AS orientation, CASE WHEN p_partkey % 6 <> 0 THEN 'Yes' ELSE split_part(p_name, ' ', 1) END AS pm_leg_outcome FROM part""")
def review_sheet(spark, d):
    """V8; the titles name both words, so neither outcome is the subject."""
    return V.review_sheet(review_pairs(spark, d)).select("pm_id", "orientation", "pm_leg_outcome")


def scratch(spark, name: str) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH RECURSIVE {REVIEW} SELECT pm_id, k_id, series, k_sub, k_title, k_rules, pm_title, pm_desc, CASE WHEN k % 6 = 0 THEN nm[1] ELSE 'Yes' END AS leg_outcome FROM rv")
def review_lines(spark, d):
    """Written as JSON lines and read again."""
    path = scratch(spark, "review")
    T.write_lines(review_pairs(spark, d), path)
    return A.review_lines(spark, path).select("pm_id", "k_id", "series", "k_sub", "k_title", "k_rules", "pm_title", "pm_desc", F.get("pm_outcomes", F.col("pm_leg")).alias("leg_outcome"))


@query(W.with_views("pr", f", c AS ({_PAIRED}) SELECT row_number() OVER (ORDER BY score DESC, pm_id) - 1 AS line, pm_id, k_id, score, (pm_id IN (SELECT market_id FROM pr WHERE platform = 'pm' AND price > 0.9)) AND (k_id IN (SELECT market_id FROM pr WHERE platform = 'k' AND price > 0.9)) AS both_priced, NULL::VARCHAR AS verified FROM c"))
def candidates_csv(spark, d):
    """A sorted report as one CSV file, read again with the numbers of its lines."""
    path = scratch(spark, "candidates")
    rows = M.with_both_priced(scored_users(spark, d), W.prices(spark, d).where("price > 0.9")).select("pm_id", "k_id", "score", "both_priced", F.lit(None).cast("string").alias("verified"))
    T.write_csv(rows, path, F.col("score").desc(), "pm_id")
    return A.candidates_csv(spark, path).withColumn("line", F.monotonically_increasing_id())


@query(W.with_views("om", """, mc AS (SELECT platform, count(*) AS total, count_if(outcome IS NULL)::BIGINT AS no_outcome, count_if(category IS NULL)::BIGINT AS no_category FROM om GROUP BY 1)
  SELECT * FROM (VALUES (0, '## Markets'), (1, ''), (2, '| platform | total | no_outcome | no_category |'), (3, '| --- | --- | --- | --- |')) h(line, text)
  UNION ALL SELECT (row_number() OVER (ORDER BY platform) + 3)::INT, '| ' || platform || ' | ' || total || ' | ' || no_outcome || ' | ' || no_category || ' |' FROM mc"""))
def markdown_report(spark, d):
    """Written as Markdown and read again."""
    m = W.order_markets(spark, d)
    counts = m.groupBy("platform").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("outcome").isNull()).alias("no_outcome"), F.count_if(F.col("category").isNull()).alias("no_category"))
    path = scratch(spark, "report")
    T.write_markdown(counts, path, "Markets", "platform")
    return spark.read.text(path).select(F.monotonically_increasing_id().cast("int").alias("line"), F.col("value").alias("text"))


@query(W.with_views("em", "SELECT count(*) AS rows, count_if(outcome IS NULL)::BIGINT AS unresolved, count_if(volume IS NULL)::BIGINT AS without_volume FROM em"))
def observed_counts(spark, d):
    """Counters of a write, taken while it runs."""
    rows, seen = T.counted(W.event_markets(spark, d), "markets", unresolved=F.col("outcome").isNull(), without_volume=F.col("volume").isNull())
    rows.write.format("noop").mode("overwrite").save()
    found = seen.get
    return spark.createDataFrame([tuple(int(found[k]) for k in ("rows", "unresolved", "without_volume"))], "rows long, unresolved long, without_volume long")


# --- statistics -----------------------------------------------------------------------------------------------------

LOSS = "-(y * ln(greatest(1e-6, least(1 - 1e-6, {p}))) + (1 - y) * ln(1 - greatest(1e-6, least(1 - 1e-6, {p}))))"


@query(W.with_views("hz", f"SELECT platform, horizon, {r('avg(' + LOSS.format(p='p') + ') AS log_loss', 'avg((p - y) * (p - y)) AS brier')} FROM sn GROUP BY 1, 2"))
def forecast_losses(spark, d):
    """A9, A30."""
    return W.snapshots(spark, d).groupBy("platform", "horizon").agg(X.log_loss(F.col("y"), F.col("p")).alias("log_loss"), C.brier(F.col("p"), F.col("y")).alias("brier"))


@query(W.with_views("hz", f"""SELECT platform, {r('avg(x) AS mean_difference', 'stddev_samp(x) / sqrt(count(*)) AS std_error')}, count(*) AS n, {r('avg(x) / (stddev_samp(x) / sqrt(count(*))) AS t_stat')}
  FROM (SELECT platform, {LOSS.format(p='p')} - {LOSS.format(p='0.5')} AS x FROM sn WHERE horizon = '24h') GROUP BY 1"""))
def paired_losses(spark, d):
    """A31."""
    return X.paired_loss(W.snapshots(spark, d).where("horizon = '24h'").withColumn("half", F.lit(0.5)), "p", "half", "platform")


@query(W.with_views("hz", f"SELECT platform, horizon, {r('avg(y - p) AS mean', 'avg(y - p) - 1.959963984540054 * stddev_samp(y - p) / sqrt(count(*)) AS low', 'avg(y - p) + 1.959963984540054 * stddev_samp(y - p) / sqrt(count(*)) AS high')}, count(*) AS n FROM sn GROUP BY 1, 2"))
def naive_intervals(spark, d):
    """A32."""
    return X.naive_interval(W.snapshots(spark, d).withColumn("e", F.col("y") - F.col("p")), "e", "platform", "horizon")


BOOT = """, cs AS (SELECT {keys}, cluster, sum(e) AS s, count(*) AS m, row_number() OVER (PARTITION BY {keys} ORDER BY cluster) - 1 AS place, count(*) OVER (PARTITION BY {keys}) AS nc FROM ({source}) GROUP BY {keys}, cluster),
  dr AS (SELECT {keys}, rep, ('0x' || substr(md5('42:' || rep || ':' || draw), 1, 8))::UBIGINT % nc AS place FROM (SELECT DISTINCT {keys}, nc FROM cs), range({n}) a(rep), range(1000) b(draw) WHERE draw < nc),
  mr AS (SELECT {keys}, rep, sum(s) / sum(m) AS mean FROM dr JOIN cs USING ({keys}, place) GROUP BY {keys}, rep),
  bd AS (SELECT {keys}, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM mr GROUP BY {keys}),
  tt AS (SELECT {keys}, count(*) AS n_clusters, sum(m)::BIGINT AS n_obs, sum(s) / sum(m) AS mean FROM cs GROUP BY {keys})"""
_ERRORS = "SELECT platform, cluster, y - p AS e FROM sn WHERE horizon = '24h'"


def errors(spark, d):
    return W.snapshots(spark, d).where("horizon = '24h'").withColumn("e", F.col("y") - F.col("p"))


@query(W.with_views("hz", BOOT.format(keys="platform", source=_ERRORS, n=800)) + f" SELECT platform, n_clusters, n_obs, {r('mean', 'low', 'high')} FROM tt JOIN bd USING (platform)")
def cluster_bootstrap(spark, d):
    """X1."""
    return X.cluster_bootstrap(errors(spark, d), "e", "cluster", "platform")


@query(W.with_views("hz", BOOT.format(keys="platform", source=_ERRORS, n=800)) + f""", nv AS (SELECT platform, 2 * 1.959963984540054 * stddev_samp(e) / sqrt(count(*)) AS width FROM ({_ERRORS}) GROUP BY 1)
  SELECT platform, n_clusters, n_obs, {r('mean', 'low', 'high', '(high - low) / width AS design_effect', 'n_obs / ((high - low) / width * ((high - low) / width)) AS effective_n')} FROM tt JOIN bd USING (platform) JOIN nv USING (platform)""")
def design_effect(spark, d):
    """X2, X3."""
    return X.design_effect(errors(spark, d), "e", "cluster", "platform")


_SEGMENTED = "SELECT platform, CASE WHEN p < 0.1 THEN 'longshot' ELSE 'favourite' END AS segment, cluster, p, y AS e FROM sn WHERE horizon = '24h' AND (p < 0.1 OR p > 0.9)"
_ENOUGH = f"SELECT * FROM ({_SEGMENTED}) QUALIFY count(*) OVER (PARTITION BY platform, segment) >= 8"


@query(W.with_views("hz", BOOT.format(keys="platform, segment", source=_ENOUGH, n=800)) + f""",
  nv AS (SELECT platform, segment, implied, {WILSON.replace('ci_low', 'wilson_low').replace('ci_high', 'wilson_high')} FROM (SELECT platform, segment, avg(p) AS implied, sum(e) AS hits, count(*) AS n FROM ({_SEGMENTED}) GROUP BY 1, 2)),
  vd AS (SELECT *, implied NOT BETWEEN wilson_low AND wilson_high AS naive_significant, implied NOT BETWEEN low AND high AS clustered_significant FROM tt JOIN bd USING (platform, segment) JOIN nv USING (platform, segment))
  SELECT platform, segment, n_clusters, n_obs, {r('mean', 'low', 'high', 'implied', 'wilson_low', 'wilson_high')}, naive_significant, clustered_significant,
    CASE WHEN naive_significant AND clustered_significant THEN 'significant both ways' WHEN naive_significant THEN 'lost under clustering' ELSE 'not significant either way' END AS verdict FROM vd""")
def robustness_table(spark, d):
    """X4."""
    return X.robustness(W.snapshots(spark, d).where("horizon = '24h'"), least=8)


@query("WITH c AS (SELECT quantile_cont(epoch_us(o_orderdate), 0.7) AS cut FROM orders) SELECT epoch_us(o_orderdate) > cut AS is_test, count(*) AS n, min(o_orderkey) AS first_key FROM orders, c GROUP BY 1")
def temporal_split(spark, d):
    """W12."""
    o = table(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    return S.temporal_split(o, "o_orderdate").groupBy("is_test").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))


def features(spark, d):
    m = W.event_markets(spark, d).where("outcome is not null").withColumn("bucket", titles.category_bucket(F.col("platform"), F.col("category")))
    return X.feature_frame(W.clean(spark, d), m)


_LOGIT = "ln(greatest(1e-6, least(1 - 1e-6, {p})) / (1 - greatest(1e-6, least(1 - 1e-6, {p}))))"
_FEATURES = W.with_views("st em", f""", sn1 AS (SELECT platform, market_id, arg_max(price, (ts, price)) FILTER (ts <= anchor - 86400) AS p_now, arg_max(price, (ts, price)) FILTER (ts <= anchor - 691200) AS p_before, min(ts) AS first_ts, any_value(anchor) AS anchor, any_value(volume) AS volume, any_value(outcome) AS outcome, any_value(category) AS category
   FROM cl JOIN em USING (platform, market_id) WHERE outcome IS NOT NULL GROUP BY 1, 2)
  SELECT platform, market_id, CASE WHEN lower(category) IN ('sports', 'crypto', 'politics') THEN lower(category) WHEN lower(category) = 'weather' AND platform = 'pm' THEN 'weather' ELSE 'other' END AS bucket, anchor, {r('p_now', _LOGIT.format(p='p_now') + ' AS logit_now', 'CASE WHEN p_before IS NULL THEN 0 ELSE ' + _LOGIT.format(p='p_now') + ' - ' + _LOGIT.format(p='p_before') + ' END AS momentum', '(p_before IS NOT NULL)::INT::DOUBLE AS has_momentum', '(anchor - first_ts) / 86400.0 AS lifetime_days', 'ln(1 + coalesce(volume, 0)) AS log_volume')}, (outcome = 'YES')::INT::DOUBLE AS y FROM sn1 WHERE p_now IS NOT NULL""")


@query(_FEATURES)
def feature_frame(spark, d):
    """A33."""
    return features(spark, d)


# Newton steps of the penalised fit, as a recursive table of (step, intercept, slope)
_NEWTON = f"""WITH RECURSIVE ft AS ({_FEATURES}), cut AS (SELECT quantile_cont(anchor, 0.7) AS c FROM ft),
  tr AS (SELECT logit_now AS x, y FROM ft, cut WHERE anchor <= c), te AS (SELECT logit_now AS x, p_now AS p, y FROM ft, cut WHERE anchor > c),
  nt(i, b, w) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
    SELECT i + 1, b - (hxx * gb - hbx * gx) / (hbb * hxx - hbx * hbx), w - (hbb * gx - hbx * gb) / (hbb * hxx - hbx * hbx) FROM
      (SELECT i, b, w, sum(q - y) AS gb, sum((q - y) * x) + w AS gx, sum(q * (1 - q)) AS hbb, sum(q * (1 - q) * x) AS hbx, sum(q * (1 - q) * x * x) + 1 AS hxx
       FROM (SELECT i, b, w, x, y, 1 / (1 + exp(-(b + w * x))) AS q FROM nt, tr WHERE i < 40) GROUP BY i, b, w)),
  md AS (SELECT 'price' AS model, p, y FROM te UNION ALL SELECT 'recalibrated', 1 / (1 + exp(-(b + w * x))), y FROM te, nt WHERE i = 40 UNION ALL SELECT 'base_rate', avg(y) OVER (), y FROM te)"""


@query(f"{_NEWTON} SELECT model, count(*) AS n, round({'avg(' + LOSS.format(p='p') + ')'}, 4) + 0.0 AS log_loss, round(avg((p - y) * (p - y)), 4) + 0.0 AS brier FROM md GROUP BY 1")
def recalibration(spark, d):
    """The fit by its optimum."""
    m = X.model_comparison(features(spark, d), least_train=10, least_test=5).where("model <> 'full'")
    return m.select("model", "n", F.round("log_loss", 4).alias("log_loss"), F.round("brier", 4).alias("brier"))


@query(f"WITH ft AS ({_FEATURES}), cut AS (SELECT quantile_cont(anchor, 0.7) AS c FROM ft), tr AS (SELECT ft.* FROM ft, cut WHERE anchor <= c) "
       "SELECT name, market_id, platform, (CASE WHEN kind = 'bucket' THEN bucket ELSE platform END = value)::INT::DOUBLE AS value FROM ft, "
       "(SELECT kind, value, kind || '_' || value AS name FROM (SELECT 'bucket' AS kind, bucket AS value FROM tr UNION SELECT 'platform', platform FROM tr) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY value) > 1)")
def design_columns(spark, d):
    """The 0/1 columns, one row each."""
    split = S.temporal_split(features(spark, d).withColumn("_when", F.timestamp_seconds("anchor")), "_when", 0.3)
    rows, names = X.design_columns(split.where("not is_test"), split)
    cells = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names))
    return rows.select("platform", "market_id", F.explode(cells).alias("c")).select("c.name", "market_id", "platform", "c.value")


@query()
def model_comparison(spark, d):
    """X5, X6, X7; the fit over all columns has no SQL twin (recalibration has one)."""
    return X.model_comparison(features(spark, d), least_train=50, least_test=20)


# --- tables ---------------------------------------------------------------------------------------------------------


def customers(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS c_name, {r('CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal')} FROM customer UNION ALL SELECT -1, 'added', 0.0")
def upserted(spark, d):
    """D1, D2."""
    c = customers(spark, d)
    new = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("new").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return T.upsert(c, new.union(spark.createDataFrame([(-1, "added", 0.0)], c.schema)), ["c_custkey"])


@query(f"SELECT c_custkey, c_name, {r('c_acctbal')} FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'late', 0.5 FROM customer WHERE c_custkey % 2 = 1 AND c_acctbal > 0")
def insert_ignored(spark, d):
    """D3, D4."""
    c = customers(spark, d)
    new = c.select("c_custkey", F.lit("late").alias("c_name"), F.when(F.col("c_acctbal") > 0, F.lit(0.5)).alias("c_acctbal"))
    return T.insert_ignore(c.where("c_custkey % 2 = 0"), new, ["c_custkey"], required=("c_acctbal",))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def missing_keys(spark, d):
    """J12, J13."""
    return T.missing(customers(spark, d).select("c_custkey"), table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct(), ["c_custkey"])


@query("SELECT c_custkey FROM customer ORDER BY md5('42:' || c_custkey), c_custkey LIMIT 50")
def deterministic_sample(spark, d):
    """T6."""
    return T.deterministic_sample(customers(spark, d), "c_custkey", 50)


@query("SELECT market_id, liquidity FROM (SELECT o_orderkey::VARCHAR AS market_id, round(o_totalprice, 6) AS liquidity FROM orders WHERE o_orderstatus = 'P') ORDER BY liquidity DESC, market_id LIMIT 20")
def most_liquid(spark, d):
    """T4."""
    m = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("market_id"), F.col("o_totalprice").alias("liquidity"), F.when(F.col("o_orderstatus") != "P", "YES").alias("outcome"))
    return T.most_liquid(m, 20).select("market_id", "liquidity")


@query("SELECT s_suppkey, n_name AS series_category FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey < 20")
def category_lookup(spark, d):
    """J5, S7."""
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("series"))
    n = table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("series"), F.col("n_name").alias("category"))
    return T.with_category(s, n).select("s_suppkey", "series_category")


# --- parsers: records are built from the tables as the venues would spell them -----------------------------------------


def pm_records(spark, d):
    """Orders as JSON records."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    stamp = F.col("o_orderdate").cast("timestamp")
    rec = F.to_json(
        F.struct(
            k.cast("string").alias("id"),
            F.concat(F.lit("Order "), k.cast("string")).alias("question"),
            F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("startDate"),
            F.date_format(F.date_add(stamp.cast("date"), 30).cast("timestamp"), "yyyy-MM-dd HH:mm:ss'+00'").alias("closedTime"),
            F.when(k % 4 == 0, '["No", "Yes"]').when(k % 9 == 0, '["A"]').otherwise('["Yes", "No"]').alias("outcomes"),
            F.when(k % 3 == 0, '["1", "0"]').when(k % 3 == 1, '["0", "1"]').otherwise('["0.4", "0.6"]').alias("outcomePrices"),
            F.concat(F.lit('["y'), k.cast("string"), F.lit('", "n'), k.cast("string"), F.lit('"]')).alias("clobTokenIds"),
            F.when(k % 5 == 0, "proposed").otherwise("resolved").alias("umaResolutionStatus"),
            F.col("o_totalprice").alias("volumeNum"),
            F.array(F.struct(F.lit("").alias("label")), F.struct(F.col("o_orderpriority").alias("label"))).alias("tags"),
            F.array(F.struct((k % 50).cast("string").alias("id"))).alias("events"),
        )
    )
    return o.select(k.alias("key"), rec.alias("record"))


def pm_raw(spark, d):
    return pm_records(spark, d).select(F.from_json("record", parse.PM_MARKET).alias("r")).select("r.*")


def archived(records: DataFrame, path: str, wrap: tuple[str, str]) -> None:
    """Pages of records as archived responses, with an older response of the same page beside each."""
    page = F.floor(F.col("key") / 400).cast("string")
    pages = records.groupBy(page.alias("page")).agg(F.concat(F.lit(wrap[0]), F.array_join(F.collect_list("record"), ","), F.lit(wrap[1])).alias("body"))
    both = pages.withColumn("at", F.explode(F.array(F.lit("2026-01-01"), F.lit("2026-06-01"))))
    rows = both.select(F.lit("https://venue/markets").alias("url"), F.create_map(F.lit("offset"), "page").alias("params"), F.col("at").alias("fetched_at"), F.when(F.col("at") == "2026-01-01", wrap[0] + wrap[1]).otherwise(F.col("body")).alias("body"))
    rows.write.mode("overwrite").option("compression", "gzip").json(path)


_PARSED_PM = f"""SELECT o_orderkey::VARCHAR AS market_id, o_orderpriority AS category, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS open_ts, strftime(o_orderdate::DATE + 30, '%Y-%m-%dT00:00:00Z') AS close_ts,
  CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 3 = 2 OR (o_orderkey % 9 = 0 AND o_orderkey % 4 <> 0) THEN NULL WHEN (o_orderkey % 3 = 0) <> (o_orderkey % 4 = 0) THEN 'YES' ELSE 'NO' END AS outcome, {r('o_totalprice AS volume')},
  CASE WHEN o_orderkey % 4 = 0 THEN 'n' || o_orderkey WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'y' || o_orderkey END AS token, (o_orderkey % 50)::VARCHAR AS cluster FROM orders"""


@query(_PARSED_PM.replace("SELECT o_orderkey::VARCHAR AS market_id,", "SELECT market_id, outcome, volume FROM (SELECT o_orderkey::VARCHAR AS market_id,") + ")")
def archived_pm_markets(spark, d):
    """Pages of an archive, the newest response of each."""
    path = scratch(spark, "archive")
    archived(pm_records(spark, d), path, ("[", "]"))
    return parse.pm_markets(A.records(A.latest_responses(A.responses(spark, path)), parse.PM_MARKET)).select("market_id", "outcome", "volume")


@query(_PARSED_PM)
def parsed_pm_markets(spark, d):
    """P1-P8, P18."""
    m = parse.pm_markets(pm_raw(spark, d))
    return m.select("market_id", "category", "open_ts", "close_ts", "outcome", "volume", "token", parse.cluster_id(F.col("platform"), F.col("raw_json"), F.col("market_id")).alias("cluster"))


def k_raw(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("KXS"), (k % 9).cast("string"), F.lit("-"), k.cast("string")).alias("ticker"),
        F.when(k % 6 != 0, F.concat(F.lit("KXS"), (k % 9).cast("string"), F.lit("-E"))).alias("event_ticker"),
        F.col("o_orderpriority").alias("title"),
        F.lit(None).cast("string").alias("yes_sub_title"),
        F.lit(None).cast("string").alias("rules_primary"),
        F.when(k % 10 == 0, "scalar").otherwise("binary").alias("market_type"),
        F.when(k % 3 == 0, "yes").when(k % 3 == 1, "no").otherwise("").alias("result"),
        F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("open_time"),
        F.lit("rubbish").alias("close_time"),
        F.lit(None).cast("string").alias("settlement_ts"),
        F.lit("2026-06-15T06:04:30Z").alias("expiration_time"),
        F.when(k % 4 == 0, F.format_string("%.2f", "o_totalprice")).when(k % 4 == 1, "").alias("volume_fp"),
        F.lit("12.50").alias("liquidity_dollars"),
        F.lit(7.0).alias("volume"),
        F.lit(None).cast("double").alias("liquidity"),
    )


_PARSED_K = f"""SELECT 'KXS' || o_orderkey % 9 || '-' || o_orderkey AS market_id, 'KXS' || o_orderkey % 9 AS series, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS open_ts, NULL::VARCHAR AS close_ts, '2026-06-15T06:04:30Z' AS resolve_ts,
  CASE o_orderkey % 3 WHEN 0 THEN 'YES' WHEN 1 THEN 'NO' END AS outcome, {r('CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice ELSE 7.0 END AS volume')}, 12.5::DOUBLE AS liquidity FROM orders WHERE o_orderkey % 10 <> 0"""


@query(f"SELECT market_id, series, outcome, volume FROM ({_PARSED_K})")
def archived_k_markets(spark, d):
    """Pages that hold their records under a name."""
    path = scratch(spark, "archive")
    raw = k_raw(spark, d)
    key = F.substring_index("ticker", "-", -1).cast("long")
    archived(raw.select(key.alias("key"), F.to_json(F.struct(*raw.columns)).alias("record")), path, ('{"cursor": "", "markets": [', "]}"))
    return parse.k_markets(A.records(A.latest_responses(A.responses(spark, path)), parse.K_MARKET, "markets")).select("market_id", "series", "outcome", "volume")


@query(_PARSED_K)
def parsed_k_markets(spark, d):
    """P10, P11, P14."""
    return parse.k_markets(k_raw(spark, d)).select("market_id", "series", "open_ts", "close_ts", "resolve_ts", "outcome", "volume", "liquidity")


@query(f"SELECT user_id::VARCHAR AS market_id, floor(epoch(ts))::BIGINT AS ts, {r('json_extract_string(props, $$$.k$$)::DOUBLE / 100 AS price')} FROM events WHERE event_type <> 'error'")
def parsed_pm_prices(spark, d):
    """P9, S6."""
    e = table(spark, d, "events")
    point = F.struct(F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), F.when(F.col("event_type") != "error", F.get_json_object("props", "$.k").cast("double") / 100).alias("p"))
    raw = e.groupBy("user_id").agg(F.collect_list(point).alias("history"))
    return parse.pm_prices(raw, F.col("user_id").cast("string")).select("market_id", "ts", "price")


@query(f"SELECT event_id::VARCHAR AS market_id, floor(epoch(ts))::BIGINT AS ts, {r('CASE WHEN event_type <> $$error$$ THEN value / 1000 END AS price', '0.25::DOUBLE AS bid')}, NULL::DOUBLE AS ask FROM events WHERE event_id % 3 <> 0")
def parsed_candles(spark, d):
    """P12, S9."""
    e = table(spark, d, "events")
    side = lambda c: F.struct(F.lit(None).cast("string").alias("open_dollars"), F.lit(None).cast("string").alias("high_dollars"), F.lit(None).cast("string").alias("low_dollars"), c.alias("close_dollars"))
    candle = F.struct(
        F.when(F.col("event_id") % 3 != 0, F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("end_period_ts"),
        F.lit("1").alias("volume_fp"),
        side(F.when(F.col("event_type") != "error", (F.col("value") / 1000).cast("string"))).alias("price"),
        side(F.lit("0.25")).alias("yes_bid"),
        side(F.lit("x")).alias("yes_ask"),
    )
    raw = e.select(F.col("event_id").cast("string").alias("ticker"), F.array(candle).alias("candlesticks"))
    return parse.k_prices(raw).select("market_id", "ts", "price", "bid", "ask")


@query("SELECT o_orderkey FROM orders WHERE coalesce(o_orderpriority <> '5-LOW', true) AND o_orderstatus <> 'P' AND NOT starts_with(o_orderkey::VARCHAR, '12')")
def kept_series(spark, d):
    """P13."""
    o = table(spark, d, "orders")
    return o.where(parse.keep_series(F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_orderkey").cast("string"), ("5-LOW",), ("P",), ("12",))).select("o_orderkey")


@query(f"""SELECT s_suppkey, {r('round((s_suppkey % 40 + 30) / 100.0, 2) AS best_bid', 'round(1 - (s_suppkey % 25 + 5) / 100.0, 2) AS best_ask')}, 2 AS bids, 1 AS asks FROM supplier""")
def parsed_books(spark, d):
    """P15, P16, P17."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    yes = F.format_string("%.2f", ((k % 40 + 30) / 100.0))
    no = F.format_string("%.2f", ((k % 25 + 5) / 100.0))
    payload = F.concat(F.lit('{"orderbook_fp": {"yes_dollars": [["0.01", "5"], ["'), yes, F.lit('", "10"], ["0.99", "0"]], "no_dollars": [["'), no, F.lit('", "3"]]}}'))
    bids, asks = B.pair_ladder_book(payload)
    return s.select("s_suppkey", B.best_price(bids).alias("best_bid"), B.best_price(asks).alias("best_ask"), F.size(bids).alias("bids"), F.size(asks).alias("asks"))


@query("SELECT event_type, sha256('https://x/' || event_type || '?a=1&b=' || event_id) AS key, event_id FROM events")
def content_keys(spark, d):
    """S4."""
    e = table(spark, d, "events")
    params = F.map_from_arrays(F.array(F.lit("b"), F.lit("a")), F.array(F.col("event_id").cast("string"), F.lit("1")))
    return e.select("event_type", parse.content_key(F.concat(F.lit("https://x/"), "event_type"), params).alias("key"), "event_id")


@query(f"SELECT k, n, {r('CASE WHEN n = 0 THEN 0.0 ELSE round(100.0 * k / n, 2) END AS pct', 'CASE WHEN n <= 0 THEN CASE WHEN k > 0 THEN 1.0 ELSE 0.0 END ELSE least(1.0, k / n) END AS ratio')} FROM (SELECT p_partkey % 7 AS k, p_partkey % 11 AS n FROM part)")
def scalar_ratios(spark, d):
    """F8, F9."""
    p = table(spark, d, "part").select((F.col("p_partkey") % 7).alias("k"), (F.col("p_partkey") % 11).alias("n"))
    return p.select("k", "n", percent(F.col("k"), F.col("n")).alias("pct"), coverage_ratio(F.col("k"), F.col("n")).alias("ratio"))


@query(f"SELECT DISTINCT hits, n, {WILSON} FROM (SELECT p_partkey % 7 AS hits, p_partkey % 7 + p_partkey % 11 AS n FROM part)")
def wilson_intervals(spark, d):
    """2.12."""
    p = table(spark, d, "part").select((F.col("p_partkey") % 7).alias("hits"), (F.col("p_partkey") % 7 + F.col("p_partkey") % 11).alias("n")).distinct()
    low, high = wilson_interval(F.col("hits"), F.col("n"))
    return p.select("hits", "n", low.alias("ci_low"), high.alias("ci_high"))


# --- streaming: books arrive as files ------------------------------------------------------------------------------------------------------


@query(f"SELECT date_trunc('hour', ts)::TIMESTAMP AS start, CASE WHEN event_type IN ('view', 'click') THEN 'pm' ELSE 'k' END AS platform, count(*) AS n, {r('sum(value) AS total')} FROM events GROUP BY 1, 2")
def streamed_windows(spark, d):
    """Hourly windows through Structured Streaming, drained in complete mode."""
    schema = table(spark, d, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    rows = raw.select(F.col("ts").cast("timestamp").alias("event_time"), F.when(F.col("event_type").isin("view", "click"), "pm").otherwise("k").alias("platform"), "value")
    out = live.drain(live.monitored(rows, value="value"), "table", scratch(spark, "windows"), mode="complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


def arriving_books(spark, d) -> DataFrame:
    """The books as a stream of JSON files."""
    path = scratch(spark, "books")
    W.books(spark, d).repartition(4).write.json(path)
    return live.book_stream(spark, path)


@query(_ORACLES["book_snapshots"])
def captured_snapshots(spark, d):
    """S10, S11, B14, D3 through Structured Streaming."""
    return live.drain(live.captured(arriving_books(spark, d)), "captured", scratch(spark, "captured"))


@query(_ORACLES["paper_signals"] + " WHERE touch_cost IS NOT NULL")
def streamed_signals(spark, d):
    """Pairs of books that arrive, traded on paper, and the signals that are left."""
    ids = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("pm_id"))
    pairs = ids.select("pm_id", F.col("pm_id").alias("k_id"), F.when(F.col("pm_id").cast("long") % 2 == 0, "crypto").otherwise("politics").alias("category"))
    sink = scratch(spark, "signals")
    live.trade_on_paper(arriving_books(spark, d), pairs, sink, scratch(spark, "sweeps"), once=True).awaitTermination()
    return live.recorded_signals(spark, sink)
