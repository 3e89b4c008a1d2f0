import datetime as dt
import gzip
import json

from pyspark.sql import functions as F

from oddsmill import cli
from oddsmill.functions import parse, similarity
from oddsmill.operators import books as B, matching as M
from oddsmill.sources import archive as A
from oddsmill.streaming import live


def envelope(url, body, at="2026-06-01T00:00:00Z", params=None):
    return json.dumps({"url": url, "params": params or {}, "fetched_at": at, "body": json.dumps(body)})


def market(i, **change):
    return {
        "id": str(i), "question": f"Will team {i} win?", "startDate": "2026-05-01T00:00:00Z", "closedTime": "2026-06-15 06:04:30+00", "outcomes": '["Yes", "No"]', "outcomePrices": '["1", "0"]',
        "clobTokenIds": '["t1", "t2"]', "umaResolutionStatus": "resolved", "volumeNum": 12.5, "events": [{"id": "e1", "slug": "s", "image": "dropped"}], "image": "dropped", "tags": [{"label": ""}, {"label": "Sports"}],
    } | change


def test_archive_of_markets(spark, tmp_path):
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        f.write(envelope("u", [market(1, question="old")], "2026-01-01") + "\n" + envelope("u", [market(1), market(2, outcomePrices='["0.5", "0.5"]')]) + "\n")
    raw = A.latest_responses(A.responses(spark, str(tmp_path)))
    assert raw.count() == 1
    rows = {r.market_id: r for r in parse.pm_markets(A.records(raw, parse.PM_MARKET)).collect()}
    assert rows["1"].outcome == "YES" and rows["1"].token == "t1" and rows["1"].category == "Sports" and rows["1"].close_ts == "2026-06-15T06:04:30Z" and rows["2"].outcome is None
    assert "dropped" not in rows["1"].raw_json and json.loads(rows["1"].raw_json)["events"][0]["id"] == "e1"


def test_candles(spark):
    empty = {}
    quotes = lambda b, a: {"yes_bid": {"close_dollars": b}, "yes_ask": {"close_dollars": a}}
    candles = [{"end_period_ts": 1, "price": empty} | quotes("0.00", "1.00"), {"end_period_ts": 2, "price": {"close_dollars": "0.05"}} | quotes("0.04", "0.06"), {"price": {"close_dollars": "0.05"}} | quotes("0.04", "0.06")]
    raw = spark.read.schema(parse.K_CANDLES).json(spark.sparkContext.parallelize([json.dumps({"ticker": "A-B", "candlesticks": candles})]))
    assert [(r.ts, r.price, r.bid, r.ask) for r in parse.k_prices(raw).orderBy("ts").collect()] == [(1, None, 0.0, 1.0), (2, 0.05, 0.04, 0.06)]


def test_day_folders_and_config(spark, tmp_path):
    for day in ("2026-06-01", "2026-06-02"):
        (tmp_path / f"day={day}").mkdir()
        (tmp_path / f"day={day}" / "x.json").write_text('{"id": 1}\n')
    assert A.day_partitions(spark, str(tmp_path), "2026-06-02", "2026-06-03", "id bigint").count() == 1
    (tmp_path / "c.json").write_text('{"archive": "raw", "match_threshold": 60, "fees": {"k": 1}}')
    c = A.load_config(str(tmp_path / "c.json"))
    assert c.archive == str(tmp_path.resolve() / "raw") and c.match_threshold == 60 and c.extra == {"fees": {"k": 1}} and A.load_config().archive == "archive"


def test_commands_from_archive_to_reports(spark, tmp_path):
    archive, tables, out = tmp_path / "archive", tmp_path / "tables", tmp_path / "reports"
    archive.mkdir()
    k = {"ticker": "KXGAME-1", "event_ticker": "KXGAME", "title": "Will team 1 win?", "market_type": "binary", "result": "yes", "open_time": "2026-05-01T00:00:00Z", "close_time": "2026-06-15T00:00:00Z"}
    (archive / "pm").mkdir()
    (archive / "k").mkdir()
    (archive / "pm" / "a.json").write_text(envelope("pm/markets", [market(1), market(2)]) + "\n")
    (archive / "k" / "a.json").write_text(envelope("k/markets", {"markets": [k], "cursor": ""}) + "\n")
    run = lambda *a: cli.main([*a, "--tables", str(tables), "--out", str(out), "--threshold", "60"])
    run("init-db")
    for _ in range(2):  # twice is the same as once
        run("ingest", "--platform", "pm", "--archive", str(archive / "pm"))
        run("ingest", "--platform", "k", "--archive", str(archive / "k"))
    store = cli.Store(spark, str(tables))
    assert store.read("markets").count() == 3
    store.write("markets", store.read("markets").withColumn("category", F.lit("Sports")))
    run("match")
    got = store.read("matches").collect()
    assert [(r.pm_id, r.k_id, r.score) for r in got] == [("1", "KXGAME-1", 100.0)]
    run("fetch-pair-prices")
    run("quality-report")
    assert spark.read.csv(str(out / "quality_counts"), header=True).count() == 2


def test_streams_equal_batches(spark, tmp_path):
    folder = tmp_path / "books"
    folder.mkdir()
    level = [{"price": 0.4, "size": 100.0}]
    for n in range(3):
        rows = [{"platform": v, "market_id": str(m), "ts": 1_700_000_000 + 60 * n, "bids": level, "asks": [{"price": 0.5, "size": 1000.0}] if m else []} for v in ("pm", "k") for m in range(3)]
        (folder / f"{n}.json").write_text("\n".join(map(json.dumps, rows + rows[:2] + [rows[0] | {"market_id": "empty", "bids": [], "asks": []}])))
    stream = live.book_stream(spark, str(folder), 1)
    got = live.drain(live.captured(stream), "captured_books", str(tmp_path / "c1"))
    batch = B.snapshots(spark.read.schema(live.BOOKS).json(str(folder))).distinct()
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect())) and batch.count() == 18
    pairs = spark.createDataFrame([(str(m), str(m), "crypto") for m in range(3)], "pm_id string, k_id string, category string")
    live.trade_on_paper(stream, pairs, str(tmp_path / "signals"), str(tmp_path / "c2"), once=True).awaitTermination()
    signals = live.recorded_signals(spark, str(tmp_path / "signals"))
    assert signals.count() == 6 and {r.pm_id for r in signals.collect()} == {"1", "2"}


def test_candidates_as_by_a_plain_loop(spark):
    names = ["fed cuts rates by 25 bps", "fed cuts rates by 50 bps", "will the fed cuts rates", "lakers win", "lakers vs celtics", "rain in may 3", "rain in may 4"]
    d = dt.date(2026, 5, 1)
    row = lambda v: [(f"{v}{i}", t, d + dt.timedelta(i % 3), "econ", None) for i, t in enumerate(names)]
    schema = "market_id string, text string, close_date date, bucket string, series string"
    pm, k = spark.createDataFrame(row("p"), schema), spark.createDataFrame(row("k"), schema)
    got = {(r.pm_id, r.k_id): r.score for r in M.scored_pairs(M.blocked_pairs(pm, k, 1), 70.0).collect()}
    want = {}
    for a in row("p"):
        for b in row("k"):
            s = similarity.token_set_ratio_of(a[1], b[1])
            if abs((a[2] - b[2]).days) <= 1 and s >= 70:
                want[a[0], b[0]] = s
    assert got == want
