"""Files in and out."""

from pyspark.sql import functions as F

from barweave.sources import io as S


def test_csv_bars_by_file_name(spark, tmp_path):
    (tmp_path / "abc_1h.csv").write_text("Timestamp, OPEN,high,low,close,volume\n2024-01-01 00:00:00,1,2,0.5,1.5,10\n2024-01-01 00:00:00+00:00,1,2,0.5,1.7,11\nbad,1,1,1,1,1\n2024-01-01 01:00:00,1,2,1,,3\n")
    (tmp_path / "xyz_15m.csv").write_text("date,open,high,low,close,volume\n2024-01-02,1,1,1,1,1\n")
    rows = {(r["asset"], r["res"]): r for r in S.read_ohlcv(spark, [str(tmp_path / "abc_1h.csv")]).collect()}
    assert list(rows) == [("abc", "1h")] and rows["abc", "1h"]["close"] == 1.7
    assert [(r["asset"], r["res"], str(r["ts"])) for r in S.read_ohlcv(spark, str(tmp_path / "xyz_15m.csv")).collect()] == [("xyz", "15m", "2024-01-02 00:00:00")]


def test_csv_funding_and_news(spark, tmp_path):
    (tmp_path / "abc_funding.csv").write_text("timestamp,funding_rate,mark_price\n2024-01-01 00:00:00.012,0.1,\n2024-01-01 00:30:00,0.2,5\n1704096000000,0.3,6\n2024-01-01 12:00:00,x,1\n")
    got = {str(r["ts"]): r["funding_rate"] for r in S.read_funding(spark, str(tmp_path / "abc_funding.csv")).collect()}
    assert got == {"2024-01-01 00:00:00": 0.2, "2024-01-01 08:00:00": 0.3}
    assert S.read_funding(spark, str(tmp_path / "abc_funding.csv"), "first").where("hour(ts) = 0").first()["funding_rate"] == 0.1
    (tmp_path / "abc_news.csv").write_text("Date,Tone,Volume\n2024-01-01,1.5,3\n2024-01-01,1.6,4\n,1,1\n")
    assert [tuple(r) for r in S.read_news(spark, str(tmp_path / "abc_news.csv")).select("symbol", "news_tone", "news_volume").collect()] == [("abc", 1.6, 4.0)]


def test_partitions_are_overwritten_one_by_one(spark, tmp_path):
    path = str(tmp_path / "rules")
    S.save_rules(spark.createDataFrame([("a", "e1"), ("b", "e2")], "asset string, event string"), path)
    S.save_rules(spark.createDataFrame([("b", "e3")], "asset string, event string"), path)
    assert sorted((r["asset"], r["event"]) for r in S.load_rules(spark, path).collect()) == [("a", "e1"), ("b", "e3")]


def test_append_keeps_what_it_is_told_to(spark):
    old, new = spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string"), spark.createDataFrame([(2, "new"), (3, "new")], "k int, v string")
    for keep, want in (("last", {1: "old", 2: "new", 3: "new"}), ("first", {1: "old", 2: "old", 3: "new"})):
        assert {r["k"]: r["v"] for r in S.incremental_append(old, new, ["k"], keep).collect()} == want


def test_malformed_json_is_dropped_or_null(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"asset": "a"}\nnot json\n{"asset": "b", "outcome": "hit"}\n')
    assert {r["asset"] for r in S.read_ledger(spark, str(tmp_path / "l.json")).where(F.col("asset").isNotNull()).collect()} == {"a", "b"}
    assert S.parse_klines(spark.createDataFrame([("x",), (None,), ("[]",)], "payload string")).count() == 0
