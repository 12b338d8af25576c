import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tickweave.bars import build_bars, daily_bars
from tickweave.sources import catalog as C
from tickweave.sources import gather as G
from tickweave.sources.synthetic import Distribution, ReturnParams, synthetic_bars
from tickweave.streaming.bars import streaming_bars

DATA = "/root/testdata/sf0.001"


def test_store(spark, tmp_path):
    for ticker, extra in (("AAA", ""), ("B B", ", 1 AS more")):
        folder = tmp_path / "prices/equities/1d"
        folder.mkdir(parents=True, exist_ok=True)
        spark.sql(f"SELECT DATE '2024-01-01' + CAST(id AS INT) AS date, 1.0D AS Open, 2.0D AS High, 0.5D AS Low, CAST(id AS DOUBLE) AS Close, id AS Volume{extra} FROM range(5)").toPandas().to_parquet(folder / f"{ticker}.parquet")
    (tmp_path / "metadata").mkdir()
    (tmp_path / "metadata/equities.csv").write_text("symbol,sector,market_cap\nAAA,Tech,5\nB B,Energy,7\n")
    with C.PriceStore(spark, str(tmp_path)) as store:
        store.register()
        assert store.list_available_tickers() == ["AAA", "B B"]
        one = store.get_price_data("AAA", "2024-01-02", "2024-01-03", ["close"])
        assert one.columns == ["date", "close"] and one.count() == 2
        assert store.get_price_data(["AAA", "none"]).count() == 5 and store.get_price_data("none").count() == 0
        assert {r["ticker"]: r["close"] for r in store.get_latest_prices().collect()} == {"AAA": 4.0, "B B": 4.0}
        assert store.get_date_range("AAA").first()["last_date"] == date(2024, 1, 5)
        assert spark.sql("SELECT count(*) FROM metadata").first()[0] == 2
        with pytest.raises(ValueError):
            store.get_date_range("none")
        with pytest.raises(NotImplementedError):
            store.get_price_data("AAA", frequency="1h")
        meta = store.metadata()
        assert C.filter_metadata(meta, filters={"sector": ["Tech"], "market_cap": 5}).count() == 1
        assert C.sample_symbols(meta, 5, min_market_cap=6).first()[0] == "B B"
        assert [r[0] for r in C.distinct_values(meta, "sector").collect()] == ["Energy", "Tech"]
    assert not spark.catalog.tableExists("prices")
    with pytest.raises(ValueError):
        C.PriceStore(spark, str(tmp_path / "nowhere"))


@pytest.mark.parametrize("kind", list(Distribution))
def test_synthetic(spark, kind):
    a = synthetic_bars(spark, ["A", "B"], kind, 300, seed=1)
    b = synthetic_bars(spark, ["B", "A"], kind, 300, seed=1).repartition(3)
    rows = a.toPandas()
    assert len(rows) == 600 and (rows.high >= rows[["open", "close"]].max(axis=1)).all() and (rows.low <= rows[["open", "close"]].min(axis=1)).all()
    assert (rows.volume > 0).all() and rows.ts.dt.weekday.max() < 5 and a.exceptAll(b).isEmpty()


def test_synthetic_moments_and_frequencies(spark):
    from tickweave.sources.synthetic import _returns, calendar

    r = _returns(calendar(spark, ["A"], 20000, "H"), Distribution.NORMAL, ReturnParams(0.001, 0.02), 3).agg(F.avg("r"), F.stddev("r")).first()
    assert abs(r[0] - 0.001) < 0.001 and abs(r[1] - 0.02) < 0.001
    minutes = synthetic_bars(spark, "A", periods=500, freq="T").toPandas()
    assert len(minutes) == 500 and minutes.ts.dt.hour.between(9, 15).all() and minutes.ts.is_unique
    with pytest.raises(ValueError):
        synthetic_bars(spark, "A", "nothing")
    with pytest.raises(ValueError):
        synthetic_bars(spark, "A", freq="Q")


def test_gatherer(spark):
    eod = json.dumps([{"date": "2024-01-02", "open": 1, "high": 2, "low": 0.5, "close": 1.5, "volume": 10}])
    av = json.dumps({"Meta Data": {}, "Time Series (Daily)": {"2024-01-03": {"1. open": "1", "2. high": "2", "3. low": "1", "4. close": "2", "6. volume": "7"}}})
    chart = json.dumps({"chart": {"result": [{"timestamp": [1704153600], "indicators": {"quote": [{"open": [2], "high": [4], "low": [2], "close": [4], "volume": [5]}], "adjclose": [{"adjclose": [2]}]}}]}})
    g = G.Gatherer(spark, spark.createDataFrame([("XX",)], "symbol string"), eodhd={"read": lambda u: eod}, alphavantage={"read": lambda u: av}, yahoo={"read": lambda u: chart}, tws={"client": lambda **k: [("2024-01-02", 1, 2, 0.5, 1.5, 3)]})
    assert g.get("Random").first()["symbol"] == "XX" and g.get("SPY").first()["close"] == 1.5
    assert g.get("SPY", "alphavantage").first()["volume"] == 7 and g.get("SPY", "yahoo").first()["open"] == 1.0
    assert g.get("SPY", "tws", end_date="20240101 10:00:00").count() == 1 and g.get("SPY", "synthetic", periods=3).count() == 3

    def fails(url):
        raise OSError

    assert G.EndOfDay(spark, read=fails).fetch("SPY").count() == 0 and G.TimeSeries(spark, read=lambda u: "{}").fetch("SPY").count() == 0
    with pytest.raises(ValueError):
        g.get("SPY", "nothing")
    assert "synthetic" in G.list_sources() and G.to_unix("2024-01-01") == 1704085200


def test_bars(spark):
    t = datetime(2024, 1, 1)
    rows = spark.createDataFrame([("a", t, 2.0, 1.0, 2), ("a", t, 1.0, 3.0, 1), ("a", t, 5.0, None, 3), (None, t, 1.0, 1.0, 1)], "s string, t timestamp_ntz, p double, v double, o int")
    bar = build_bars(rows, F.col("s"), F.col("t"), F.col("p"), F.col("v"), F.col("o")).collect()
    assert len(bar) == 1 and (bar[0]["open"], bar[0]["close"], bar[0]["volume"]) == (1.0, 5.0, 4.0)
    assert daily_bars(spark.read.parquet(f"{DATA}/lineitem.parquet")).where("high < low").count() == 0


def test_streaming_bars_match_the_table(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streaming_bars(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "event_type", "ts", "value", F.lit(1.0))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("made_bars").start()
    q.processAllAvailable()
    q.stop()
    table = streaming_bars(events, "event_type", "ts", "value", F.lit(1.0))
    assert spark.table("made_bars").exceptAll(table).isEmpty() and table.count() == spark.table("made_bars").count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
