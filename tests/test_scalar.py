import math
import random

import pytest
from pyspark.sql import functions as F

from oddsmill.functions import parse, prices as P, similarity, titles
from oddsmill.operators import backtest as BT, books as B, stats as X


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_usable_price_truth_table(spark):
    cases = [
        (0.55, 0.54, 0.56, 0.55), (0.60, 0.54, 0.56, 0.60), (0.42, None, None, 0.42), (0.96, 0.08, 0.14, 0.11), (0.01, 0.50, 0.62, 0.56), (0.96, 0.05, 0.60, None),
        (0.97, 0.0, 0.97, None), (None, 0.40, 0.44, 0.42), (None, 0.10, 0.90, None), (None, 0.0, 1.0, None), (None, None, None, None), (None, 0.60, 0.40, None), (0.3, 0.2, None, 0.3),
    ]
    got = values(spark, [c[:3] for c in cases], "p double, b double, a double", P.usable_price(F.col("p"), F.col("b"), F.col("a")))
    assert [x[0] if x[0] is None else round(x[0], 9) for x in got] == [c[3] for c in cases]


def test_wilson(spark):
    low, high = P.wilson_interval(F.col("k"), F.col("n"))
    got = values(spark, [(8, 10), (0, 0), (5, 5)], "k long, n long", low, high)
    assert got[0] == pytest.approx((0.4902, 0.9433), abs=1e-3) and got[1] == (0, 1) and got[2][1] == 1
    assert X.wilson(8, 10) == pytest.approx(got[0]) and X.wilson(0, 0) == (0, 1)


def test_scalars(spark):
    got = values(spark, [(80, 100), (120, 100), (0, 0), (1, 0)], "d long, l long", P.coverage_ratio(F.col("d"), F.col("l")), P.percent(F.col("d"), F.col("l")))
    assert got == [(0.8, 80.0), (1.0, 120.0), (0.0, 0.0), (1.0, 0.0)]
    assert values(spark, [(1.0,), (0.29,), (0.0,)], "p double", P.probability_bin(F.col("p"))) == [(9,), (2,), (0,)]
    assert values(spark, [(0.07, 0.5)], "r double, p double", P.taker_fee(F.col("r"), F.col("p")))[0][0] == pytest.approx(0.0175)
    assert values(spark, [(0.6, None), (0.6, 0.5)], "a double, b double", P.momentum(F.col("a"), F.col("b"))) == [(0.0,), (pytest.approx(math.log(1.5)),)]


def test_titles(spark):
    raw = ["Points O/U 15.5", "Spread: Mexico (-3.5)", "between 84-85°F on May 31", "win the 2026 French Open", "UT-01 nominee", None]
    got = values(spark, [(t,) for t in raw], "t string", titles.numbers(titles.normalize_title(F.col("t"))), titles.normalize_title(F.col("t")))
    assert [x[0] for x in got] == [[15.5], [3.5], [31.0, 84.0, 85.0], [], [1.0], []]
    assert got[0][1] == "points o u 15.5" and got[5][1] == ""
    pairs = [
        ("a vs b", "a to win"), ("a vs b", "a total"), ("over 15.5", "over 15"), ("highest temp 70", "lowest temp 70"), ("1st half a", "2nd half a"), ("toss winner a", "winner a"),
        ("rain", "snow"), ("highest temp 70", "temp 70"), ("total 15", "total 15.0"),
    ]
    assert [x[0] for x in values(spark, pairs, "a string, b string", titles.compatible(F.col("a"), F.col("b")))] == [True, False, False, False, False, False, True, True, True]
    assert values(spark, [("high in new york", "KXHIGHNY"), ("high in boston", "KXHIGHNY"), ("x", "KXHIGHZZ"), ("x", None)], "t string, s string", titles.weather_city_ok(F.col("t"), F.col("s"))) == [(True,), (False,), (False,), (False,)]
    assert values(spark, [("pm", "Geopolitics"), ("k", "Economics"), ("pm", None), ("k", "Soccer")], "p string, c string", titles.category_bucket(F.col("p"), F.col("c"))) == [("politics",), ("econ",), ("other",), ("other",)]
    assert values(spark, [("Who wins", '{"yes_sub_title": "Ann"}'), ("Ann wins", '{"yes_sub_title": "ann"}'), ("T", "rubbish")], "t string, r string", titles.match_text(F.col("t"), F.col("r"))) == [("Who wins Ann",), ("Ann wins",), ("T",)]


def test_similarity(spark):
    assert similarity.token_set_ratio_of("fed cuts 25", "will the fed cuts 25 bps") == 100.0
    assert similarity.token_set_ratio_of("a b", "") == 0.0
    assert similarity.ratio_of("kitten", "sitting") == pytest.approx(200 * 4 / 13)
    assert similarity.common_subsequence("abcbdab", "bdcaba") == 4
    assert values(spark, [("b a", "a b"), (None, "x")], "a string, b string", similarity.token_set_ratio(F.col("a"), F.col("b"))) == [(100.0,), (0.0,)]


def test_parsers(spark):
    stamps = ["2026-06-15 06:04:30+00", "2026-05-01T00:00:00.123456Z", "rubbish", "", None]
    assert [x[0] for x in values(spark, [(s,) for s in stamps], "s string", parse.normalize_iso(F.col("s")))] == ["2026-06-15T06:04:30Z", "2026-05-01T00:00:00Z", None, None, None]
    rows = [('["Yes", "No"]', '["1", "0"]', "resolved"), ('["No", " YES "]', '["1", "0"]', None), ('["A", "B"]', '["0.5", "0.5"]', None), ('["A"]', '["1"]', None), ("x", None, None), ('["Yes","No"]', '["1","0"]', "disputed")]
    o, p = parse.json_list(F.col("o")), parse.json_list(F.col("p"))
    assert values(spark, rows, "o string, p string, s string", parse.proposition_leg(o), parse.pm_outcome(o, p, F.col("s"))) == [(0, "YES"), (1, "NO"), (0, None), (None, None), (None, None), (0, None)]
    assert values(spark, [("12.5",), ("",), ("x",), (None,)], "d string", parse.dollars(F.col("d"))) == [(12.5,), (None,), (None,), (None,)]
    assert values(spark, [("pm", '{"events":[{"id":"7"}]}', "a"), ("k", '{"event_ticker":""}', "b"), ("pm", None, "c")], "p string, r string, m string", parse.cluster_id(F.col("p"), F.col("r"), F.col("m"))) == [("7",), ("solo:b",), ("solo:c",)]
    keep = parse.keep_series(F.col("f"), F.col("c"), F.col("t"), ("daily",), ("Sports",), ("KXBTC",))
    assert values(spark, [("daily", "x", "y"), (None, None, None), ("w", "Sports", "y"), ("w", "x", "KXBTCD")], "f string, c string, t string", keep) == [(False,), (True,), (False,), (False,)]


def test_entries_and_payouts(spark):
    d, c = BT.best_entry(F.col("pm"), F.col("ask"), F.col("bid"), F.lit(0.04), F.lit(1.0))
    got = values(spark, [(0.40, 0.60, 0.55), (0.45, 0.30, 0.25)], "pm double, ask double, bid double", d, c)
    assert got[0] == ("pm_yes", pytest.approx(0.887001)) and got[1][0] == "k_yes"
    pays = [("pm_yes", "YES", "YES"), ("pm_yes", "NO", "NO"), ("pm_yes", "NO", "YES"), ("pm_yes", "YES", "NO")]
    assert [x[0] for x in values(spark, pays, "d string, p string, k string", BT.realized_payout(F.col("d"), F.col("p"), F.col("k")))] == [1, 1, 0, 2]


def test_walking_a_book(spark):
    levels = [(0.50, 100.0), (0.60, 100.0)]
    df = spark.createDataFrame([(levels, n) for n in (25.0, 80.0, 500.0, 110.0, 0.0)], f"l {B.LEVELS}, n double")
    got = [r[0] for r in df.select(B.walk(F.col("l"), F.col("n"))).collect()]
    assert (got[0].vwap, got[0].contracts) == (0.5, 50) and (got[1].vwap, got[1].levels) == (pytest.approx(80 / 150), 2)
    assert not got[2].complete and got[2].filled == pytest.approx(110) and got[3].complete and got[4].complete and got[4].vwap is None
    payload = '{"orderbook_fp": {"yes_dollars": [["0.30", "5"], ["0.40", "7"], ["0.90", "0"]], "no_dollars": [["0.40", "2"], ["0.30", "1"]]}}'
    bids, asks = B.pair_ladder_book(F.col("p"))
    r = spark.createDataFrame([(payload,)], "p string").select(bids.alias("b"), asks.alias("a")).collect()[0]
    assert [x.price for x in r.b] == [0.4, 0.3] and [round(x.price, 9) for x in r.a] == [0.6, 0.7]
    b2, a2 = B.struct_book(F.lit('{"bids": [{"price": "0.1", "size": "1"}, {"price": "0.2", "size": "1"}], "asks": []}'))
    r = spark.range(1).select(b2.alias("b"), a2.alias("a")).collect()[0]
    assert [x.price for x in r.b] == [0.2, 0.1] and r.a == []


def test_pricing_a_pair(spark):
    book = lambda bid, ask: ([(bid, 1000.0)], [(ask, 1000.0)])
    schema = ", ".join(f"{c} {B.LEVELS}" for c in ("pm_bids", "pm_asks", "k_bids", "k_asks"))
    df = spark.createDataFrame([book(0.29, 0.30) + book(0.55, 0.56), book(0.70, 0.71) + book(0.29, 0.30), ([], []) + book(0.5, 0.6)], schema)
    got = [r[0] for r in df.select(B.price_pair(F.lit(0.04), None)).collect()]
    assert got[0].direction == "pm_yes" and got[0].edge > 0.05 and got[1].direction == "k_yes" and got[2].cost is None
    at = [r[0] for r in df.select(B.price_pair(F.lit(0.04), 1e6)).collect()]
    assert all(x.cost is None for x in at)


def test_common_subsequences_of_a_batch_as_one_by_one():
    import random

    rng = random.Random(2)
    word = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    pairs = [(word(x, rng.choice([0, 1, 5, 63, 64, 65, 130, 200])), word(x, rng.choice([0, 3, 64, 70, 129]))) for x in ("ab", "abcdefgh ", "aé漢\0z", "xyzw") for _ in range(40)]
    want = [similarity.common_subsequence(a, b) for a, b in pairs]
    assert similarity.common_subsequences([a for a, _ in pairs], [b for _, b in pairs]).tolist() == want
    assert similarity.common_subsequences([], []).tolist() == []


def test_best_set_ratios_as_of_all_pairs():
    pick = random.Random(11)
    words = ["will", "be", "red", "blue", "1.5", "2.5", "xab", "bax", "abx", "é", "a" * 40, "q" * 300]
    for size, least, top in ((8, 0.0, 3), (10, 60.0, 8), (12, 85.0, 1)):
        texts, others = ([sorted(pick.sample(words[:size], pick.randint(0, 6))) for _ in range(80)] for _ in range(2))
        for own, got in zip(others, similarity.best_set_ratios(texts, others, least, top), strict=True):
            all_of = sorted((-similarity.token_set_ratio_of(" ".join(t), " ".join(own)), j) for j, t in enumerate(texts))
            assert got == [(j, -s) for s, j in all_of if -s >= least][:top]
