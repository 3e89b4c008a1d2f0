import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from oddsmill.functions.similarity import token_set_ratio_of
from oddsmill.operators import backtest as BT, books as B, calibration as C, divergence as D, matching as M, quality as Q, series as S, stats as X, tables as T, verify as V

PRICES = "platform string, market_id string, ts bigint, price double"


def series(spark, *lists, platform="pm"):
    return spark.createDataFrame([(platform, str(m), t, p) for m, rows in enumerate(lists) for t, p in rows], PRICES)


def test_placeholders(spark):
    cases = [[0.5, 0.5, 0.6, 0.55], [0.5, 0.5], [0.3, 0.4], [0.004, 0.5, 0.002, 0.005], [0.48, 0.5, 0.52], [0.9, 0.5]]
    want = [[0.6, 0.55], [], [0.3, 0.4], [0.004, 0.002, 0.005], [0.48, 0.5, 0.52], [0.9]]
    out = S.strip_placeholder(series(spark, *[list(enumerate(c)) for c in cases])).collect()
    got = [[r.price for r in sorted(out, key=lambda r: r.ts) if r.market_id == str(m)] for m in range(len(cases))]
    # near-0.5 values of which none is far from 0.5 all stay
    assert got == want
    other = S.strip_placeholder(series(spark, [(0, 0.5), (1, 0.6)], platform="k"))
    assert other.count() == 2


def test_daily_and_horizons(spark):
    out = S.daily_last(series(spark, [(10, 0.4), (20, 0.5), (86405, 0.6)]), "price").orderBy("day").collect()
    assert [r.price for r in out] == [0.5, 0.6]
    m = spark.createDataFrame([("pm", "0", 300)], "platform string, market_id string, anchor bigint")
    at = S.price_at_horizons(series(spark, [(100, 0.1), (200, 0.2), (300, 0.3)]), m, {"a": 100, "b": 250, "c": 0}).collect()
    assert {r.horizon: r.snapshot for r in at} == {"a": 0.2, "c": 0.3}


def test_later_rows_do_not_change_a_snapshot(spark):
    m = spark.createDataFrame([("pm", "0", 300)], "platform string, market_id string, anchor bigint")
    one = S.price_at_horizons(series(spark, [(100, 0.1)]), m, {"a": 100}).collect()
    assert one == S.price_at_horizons(series(spark, [(100, 0.1), (250, 0.9), (900, 0.9)]), m, {"a": 100}).collect()


def test_murphy(spark):
    rows = spark.createDataFrame([(0.05, 0.0), (0.05, 1.0), (0.95, 1.0), (0.95, 1.0)], "p double, y double").withColumn("g", F.lit(1))
    r = C.murphy(rows, "g").collect()[0]
    assert (r.base_rate, r.uncertainty) == (0.75, 0.1875)
    assert (r.reliability, r.resolution, r.brier) == pytest.approx((0.5 * 0.2025 + 0.5 * 0.0025, 0.0625, 0.2275))
    assert r.brier == pytest.approx(r.reliability - r.resolution + r.uncertainty)
    t = C.calibration_table(rows, "g").orderBy("bin_low").collect()
    assert [(x.bin_low, x.n, x.yes_rate) for x in t] == [(0.0, 2, 0.5), (0.9, 2, 1.0)]
    assert spark.createDataFrame([(1.0, 1.0), (0.5, 0.0), (0.0, 0.0)], "p double, y double").agg(C.brier(F.col("p"), F.col("y"))).collect()[0][0] == pytest.approx(0.25 / 3)


def test_spreads(spark):
    rows = spark.createDataFrame([(1.0,), (-3.0,), (6.0,), (-12.0,)], "spread double").withColumn("g", F.lit(1))
    r = D.spread_stats(rows, "g").collect()[0]
    assert tuple(r)[1:] == (4, 5.5, 12.0, 75.0, 50.0, 25.0)
    pairs = spark.createDataFrame([("a", "b", "same"), ("c", "d", "inverse")], "pm_id string, k_id string, orientation string")
    pm = spark.createDataFrame([("a", 0, 0.6), ("a", 1, 0.7), ("a", 2, 0.8), ("c", 0, 0.6)], "market_id string, day int, price double")
    k = spark.createDataFrame([("b", 1, 0.65), ("b", 2, 0.8), ("b", 3, 0.9), ("d", 0, 0.35)], "market_id string, day int, price double")
    got = {(r.pm_id, r.day): round(r.spread, 6) for r in D.align_pairs(pairs, pm, k).collect()}
    assert got == {("a", 1): 5.0, ("a", 2): 0.0, ("c", 0): -5.0}


def test_half_lives(spark):
    cases = [([0, 1, 8, 6, 5, 3, 1], [3]), ([0, 6, 10, 7, 5], [2]), ([0, 8, 7, 6], []), ([8, 3, 0, 6, 2], [1, 1]), ([8, 3], [1]), ([], [])]
    df = spark.createDataFrame([(list(map(float, a)),) for a, _ in cases], "g array<double>")
    assert [list(r[0]) for r in df.select(D.half_lives(F.col("g"))).collect()] == [b for _, b in cases]


def test_lead_lag(spark):
    pm, k = [0.1, 0.3, 0.2, 0.5, 0.4, 0.6], [0.2, 0.1, 0.3, 0.2, 0.5, 0.4]
    rows = spark.createDataFrame([("a", "b", i, x, y) for i, (x, y) in enumerate(zip(pm, k))], "pm_id string, k_id string, day int, pm double, k double")
    got = {r.lag: r["corr"] for r in D.lead_lag(rows).collect()}
    assert got[1] == pytest.approx(1.0) and got[1] > got[0] and set(got) == {-2, -1, 0, 1, 2}
    flat = rows.withColumn("k", F.lit(0.5))
    assert all(r["corr"] is None for r in D.lead_lag(flat).collect())


def test_case_studies_take_each_pair_once(spark):
    rows = [
        ("a", "x", 120, 2.0, 50.0, False),  # first and second rule: taken by the first
        ("b", "x", 60, 3.0, 45.0, False),  # second
        ("c", "x", 200, 8.0, 10.0, True),  # third, before the fourth may have it
        ("d", "x", 40, 1.0, 5.0, True),  # fourth
        ("e", "x", 31, 0.5, 2.0, False),  # fifth
        ("f", "x", 29, 0.1, 1.0, False),  # too short
    ]
    t = spark.createDataFrame(rows, "pm_id string, k_id string, n_days long, mean_abs double, max_abs double, basis_risk boolean")
    got = {r.case_name: r.pm_id for r in D.case_studies(t).collect()}
    assert got == {"calm_then_violent": "a", "one_large_gap": "b", "persistent_offset": "c", "basis_risk": "d", "typical": "e"}


def backtest_days(spark, **change):
    row = {"orientation": "same", "verified": True, "basis_risk": False, "pm_outcome": "YES", "k_outcome": "YES", "category": "crypto", "resolve_day": dt.date(2026, 6, 8)} | change
    pairs = spark.createDataFrame([("a", "b", *row.values())], "pm_id string, k_id string, orientation string, verified boolean, basis_risk boolean, pm_outcome string, k_outcome string, category string, resolve_day date")
    pm = spark.createDataFrame([("a", dt.date(2026, 6, 1), 0.5), ("a", dt.date(2026, 6, 2), 0.3), ("a", dt.date(2026, 6, 8), 0.3)], "market_id string, day date, price double")
    q = spark.createDataFrame([("b", dt.date(2026, 6, 1), 0.49, 0.51), ("b", dt.date(2026, 6, 2), 0.53, 0.55), ("b", dt.date(2026, 6, 8), 0.53, 0.55)], "market_id string, day date, bid double, ask double")
    return BT.tradable_days(pairs, pm, q)


def test_backtest(spark):
    t = BT.run_backtest(backtest_days(spark), (0.0,), edge_threshold=0.02).collect()
    assert len(t) == 1 and (t[0].entry_day, t[0].direction, t[0].days_held, t[0].payout) == (dt.date(2026, 6, 2), "pm_yes", 6, 1.0)
    assert t[0].annualized == pytest.approx(t[0].edge / t[0].cost * 365 / 6)
    assert BT.run_backtest(backtest_days(spark), (0.0,), edge_threshold=0.20).count() == 0
    assert backtest_days(spark, basis_risk=True).count() == 0 and backtest_days(spark, verified=False).count() == 0
    flipped = {r.day.day: (round(r.pm, 6), r.pm_outcome) for r in backtest_days(spark, orientation="inverse").collect()}
    assert flipped == {1: (0.5, "NO"), 2: (0.7, "NO")}


def test_backtest_of_free_entries(spark):
    days = backtest_days(spark).withColumns({"pm": F.lit(0.0), "k_bid": F.lit(1.0)})
    t = BT.run_backtest(days, (0.0, 1.0))
    got = {r.slippage: (r.cost, r.edge, r.annualized) for r in t.collect()}
    assert got[0.0] == (0.0, 1.0, math.inf) and 0 < got[1.0][0] < 0.02 and got[1.0][2] < math.inf
    summary = {r.slippage: (r.opportunities, r.mean_edge, r.median_annualized) for r in BT.backtest_summary(t, days).collect()}
    assert summary[0.0] == (1, 1.0, math.inf)


def test_backtest_summary_of_a_free_and_a_paid_entry(spark):
    free = backtest_days(spark).withColumns({"pm": F.lit(0.0), "k_bid": F.lit(1.0)})
    paid = backtest_days(spark).withColumn("pm_id", F.lit("paid"))
    days = free.unionByName(paid)
    r = BT.backtest_summary(BT.run_backtest(days, (0.0,)), days).collect()[0]
    assert (r.opportunities, r.tradable_pairs, r.paying_exactly_1) == (2, 2, 2) and 0.5 < r.mean_edge < 1 and r.median_annualized == math.inf


def inputs(spark, rows):
    return spark.createDataFrame(rows, "market_id string, text string, close_date date, bucket string, series string")


def test_matching(spark):
    d = dt.date(2026, 6, 10)
    pm = inputs(spark, [("p1", "fed cuts rates by 25 bps in june", d, "econ", None), ("p2", "lakers win game 7", d, "sports", None)])
    k = inputs(spark, [("k1", "will the fed cuts rates by 25 bps in june", d + dt.timedelta(2), "econ", None), ("k2", "fed cuts rates by 50 bps in june", d, "econ", None), ("k3", "lakers win game 7", d + dt.timedelta(3), "sports", None), ("k4", "fed cuts rates by 25 bps", d, "econ", None)])
    got = {(r.pm_id, r.k_id) for r in M.build_candidates(pm, k, 60.0).collect()}
    # k1 and k4 both score 100; the smaller id wins
    assert got == {("p1", "k1")}
    assert M.blocked_pairs(pm, k, 0).count() == 2
    assert M.build_candidates(pm, k.where("market_id = 'k2'"), 60.0).count() == 0


@pytest.mark.parametrize("threshold, window, parts", [(60.0, 3, (5, 3)), (85.0, 1, (16_384, 2_048))])
def test_candidates_without_all_pairs(spark, monkeypatch, threshold, window, parts):
    monkeypatch.setattr(M, "PM_ROWS", parts[0]), monkeypatch.setattr(M, "K_ROWS", parts[1])
    pick = random.Random(7)
    words = ["will", "red", "blue", "over", "1.5", "2.5", "max", "highest", "1st half", "win", "new york"]

    def rows(head):
        # ids, whole rows, texts repeat; some have no text, day or bucket
        out = [(f"{head}{pick.randint(0, 150)}", " ".join(pick.choices(words, k=pick.randint(0, 5))), dt.date(2026, 6, pick.randint(1, 6)), pick.choice(["sports", "weather", "econ"]), pick.choice(["KXHIGHNY", "KXHIGHMIA", None])) for _ in range(150)]
        return inputs(spark, out + out[:5] + [(f"{head}n{i}", *(None if i == j else x for j, x in enumerate(out[i][1:4])), None) for i in range(3)])

    pm, k = rows(""), rows("K")
    want = M.best_of_both(M.scored_pairs(M.blocked_pairs(pm, k, window), threshold))
    got = M.build_candidates(pm, k, threshold, window)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 10


def test_alike_markets_make_no_pairs(spark):
    d = dt.date(2026, 6, 10)
    pm, k = (inputs(spark, [(f"{v}{i:03}", "fed cuts rates", d, "econ", None) for i in range(300)]) for v in "pk")
    # 90,000 pairs
    assert [(r.pm_id, r.k_id) for r in M.top_pairs(pm, k).orderBy("pm_id").collect()] == [(f"p{i:03}", "k000") for i in range(M.TOP)]
    assert [tuple(r) for r in M.build_candidates(pm, k).collect()] == [("p000", "k000", 100.0)]


def test_pairs_by_tiles_are_all_pairs(spark, monkeypatch):
    pick = random.Random(3)
    day = lambda: pick.choice([None, *(dt.date(2026, 6, n) for n in range(1, 9))])
    pm, k = (inputs(spark, [(f"{v}{pick.randint(0, 200)}", "a", day(), pick.choice(["sports", "econ", None]), None) for _ in range(200)]) for v in "pk")
    for tile in ((8_192, 4_096, 512), (7, 20, 8)):
        monkeypatch.setattr(M, "PM_TILE", tile[0]), monkeypatch.setattr(M, "K_TILE", tile[1]), monkeypatch.setattr(M, "RUN", tile[2])
        for window in (0, 3):
            want = M.blocked_pairs(pm, k, window).select("pm_id", "k_id")
            assert sorted(map(tuple, M.pair_ids(pm, k, window).collect())) == sorted(map(tuple, want.collect()))
    monkeypatch.undo()
    # in the order of writing, the second venue's ids repeat after RUN rows, not after the block's 5,001
    pm, k = (spark.range(n).select(F.concat(F.lit(v), "id").alias("market_id"), F.lit("a").alias("text"), F.lit("2026-06-01").cast("date").alias("close_date"), F.lit("econ").alias("bucket")) for v, n in (("p", 20), ("k", 5_001)))
    rows = M.pair_ids(pm, k).collect()
    first = rows[: 20 * M.RUN]
    assert len(rows) == len(set(rows)) == 20 * 5_001 and len({r.k_id for r in first}) == M.RUN and sum(a.pm_id != b.pm_id for a, b in zip(first, first[1:])) == 19


def test_prefilter_keeps_all_pairs_that_score(spark):
    texts = ["abcdefghij abcdefghij", "abcdefghik", "abcdefghik abcdefghik zz", "zz", "other words here", "", " abcdefghij  zz "]
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts], "pm_text string, k_text string")
    got = {(r.pm_text, r.k_text, r.score) for r in M.scored_pairs(pairs).collect()}
    assert got == {(a, b, s) for a in texts for b in texts if (s := token_set_ratio_of(a, b)) >= 85} and (texts[0], texts[1], 90.0) in got


def test_best_of_both_is_per_second_venue_first(spark):
    rows = [("p1", "k1", 90.0), ("p2", "k1", 95.0), ("p1", "k2", 85.0), ("p2", "k2", 94.0)]
    d = dt.date(2026, 1, 1)
    df = spark.createDataFrame([(p, k, s, "same title", "same title", d, d, "econ", None) for p, k, s in rows], "pm_id string, k_id string, score double, pm_text string, k_text string, pm_close date, day date, bucket string, series string")
    assert [tuple(r) for r in M.best_of_both(df).collect()] == [("p2", "k1", 95.0)]


def test_verification(spark):
    schema = "pm_id string, k_id string, series string, k_sub string, k_title string, k_rules string, pm_title string, pm_desc string, pm_outcomes array<string>, pm_leg int"
    yn = ["Yes", "No"]
    rows = [
        ("1", "a", "KXNBAMVP", "Luka Dončić", "MVP?", "", "Will Luka Doncic win MVP", "", yn, 0, "1", "same"),
        ("2", "b", "KXNBAMVP", "Austin Eckroat", "MVP?", "", "Austin Smotherman MVP", "", yn, 0, "0", ""),
        ("3", "c", "KXUCL", "x", "t", "", "x", "", yn, 0, "0", ""),
        ("4", "d", "KXRT", "dune", "t", "", "Dune score", "", yn, 0, "br", "same"),
        ("5", "e", "KXUNKNOWN", "x", "t", "", "x", "", yn, 0, "", ""),
        ("6", "f", "KXEPLBTTS", "", "t", "If Arsenal FC and Chelsea both score goals", "Arsenal v Chelsea", "", yn, 0, "1", "same"),
        ("7", "g", "KXEPLBTTS", "", "t", "If Arsenal FC and Leeds both score goals", "Arsenal v Chelsea", "", yn, 0, "0", ""),
        ("8", "h", "KXIPL", "Mumbai", "soccer goals", "", "Mumbai", "cricket wickets", yn, 0, "0", ""),
        ("9", "i", "KXCS2", "Vitality", "t", "", "Spirit v Vitality", "", ["Spirit", "Vitality"], 0, "inv", "inverse"),
        ("10", "j", "KXCS2", "Vitality", "t", "", "Spirit v Vitality", "", ["Spirit", "Vitality"], 1, "1", "same"),
        ("11", "k", "KXWCGOAL", "Messi", "t", "", "Messi assist", "", yn, 0, "0", ""),
        ("12", "l", "KXANIMEBEST", "", "Award for Best Score?", "", "best score award", "", yn, 0, "1", "same"),
        ("13", "m", "KXHIGHNY", "", "t", "", "high in new york", "", yn, 0, "1", "same"),
    ]
    got = {r.pm_id: (r.code, r.oriented) for r in V.decide(spark.createDataFrame([r[:10] for r in rows], schema)).collect()}
    assert got == {r[0]: r[10:] for r in rows}


def test_losses(spark):
    rows = spark.createDataFrame([(1.0, 0.8), (0.0, 0.3)], "y double, p double")
    assert rows.agg(X.log_loss(F.col("y"), F.col("p"))).collect()[0][0] == pytest.approx(-(math.log(0.8) + math.log(0.7)) / 2)
    assert rows.agg(X.log_loss(F.col("y"), F.lit(0.5))).collect()[0][0] == pytest.approx(math.log(2))
    r = X.paired_loss(rows.withColumn("q", F.col("p")), "p", "q").collect()[0]
    assert r.mean_difference == 0 and r.t_stat is None
    assert X.paired_loss(rows.limit(1).withColumn("q", F.col("p")), "p", "q").count() == 0


def test_temporal_split_keeps_a_day_on_one_side(spark):
    rows = spark.createDataFrame([(dt.datetime(2026, m, 1),) for m in (1, 1, 1, 2, 2, 2)], "t timestamp")
    out = S.temporal_split(rows, "t", 0.5)
    assert out.select("t", "is_test").distinct().count() == 2


def test_bootstrap_of_identical_legs_is_wider_than_naive(spark):
    rows = spark.createDataFrame([(f"e{e}", float(e % 2 == 0) + e / 100) for e in range(40) for _ in range(10)], "event string, v double")
    r = X.design_effect(rows, "v", "event", n_boot=200).collect()[0]
    assert (r.n_obs, r.n_clusters) == (400, 40) and r.design_effect > 2 and r.effective_n == pytest.approx(400 / r.design_effect**2)
    alone = rows.withColumn("event", F.monotonically_increasing_id())
    assert X.design_effect(alone, "v", "event", n_boot=200).collect()[0].design_effect == pytest.approx(1, rel=0.25)


def test_tables(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k int, v string")
    once = T.upsert(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c"), (3, "e")]
    assert sorted(map(tuple, T.upsert(once, new, ["k"]).collect())) == sorted(map(tuple, once.collect()))
    assert sorted(map(tuple, T.insert_ignore(old, new.union(spark.createDataFrame([(9, None)], "k int, v string")), ["k"], ("v",)).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    ids = spark.createDataFrame([(i,) for i in range(1000)], "id int")
    one = T.deterministic_sample(ids, "id", 50).collect()
    assert one == T.deterministic_sample(ids.orderBy(F.rand()), "id", 50).collect() and len(one) == 50
    assert T.deterministic_sample(ids, "id", 5000).count() == 1000


def test_headline_boundary(spark):
    t = dt.datetime(2026, 1, 1)
    rows = [("pm", str(h), t, t + dt.timedelta(hours=h), o) for h, o in ((12, "YES"), (24, "YES"), (48, "NO"), (72, None))]
    m = spark.createDataFrame(rows, "platform string, market_id string, open_ts timestamp, close_ts timestamp, outcome string")
    assert sorted(r.market_id for r in Q.headline_markets(m).collect()) == ["24", "48"]
    assert tuple(Q.market_counts(m).collect()[0]) == ("pm", 4, 2, 1, 1)


def test_settling(spark):
    s = spark.createDataFrame([(str(i), str(i), "pm_yes", 0.9) for i in range(4)], "pm_id string, k_id string, direction string, touch_cost double")
    outcomes = [("YES", "YES"), ("YES", "NO"), ("NO", "YES"), (None, "YES")]
    m = spark.createDataFrame([(v, str(i), o[j]) for i, o in enumerate(outcomes) for j, v in enumerate(("pm", "k"))], "platform string, market_id string, outcome string")
    got = {r.pm_id: r.payout for r in B.settle(s, m).collect()}
    assert got == {"0": 1.0, "1": 2.0, "2": 0.0}


def test_all_categories_get_a_column(spark):
    from oddsmill.operators import stats

    train = spark.range(1200).selectExpr("concat('c', lpad(id, 5, '0')) as bucket", "'pm' as platform")
    rows, names = stats.design_columns(train, train.limit(3))
    assert len(names) == 1199 and "bucket_c01199" in names and set(names) < set(rows.columns)
