"""A registry of price sources, and the sources: synthetic, local Parquet, and HTTP services."""

from __future__ import annotations

import json
import os
from abc import ABC, abstractmethod
from collections.abc import Callable
from datetime import datetime, timedelta
from urllib.parse import urlencode
from urllib.request import urlopen
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.sources.synthetic import synthetic_bars

#: Days in a duration, seconds in a bar, and the names that services have for bars.
DURATION_DAYS = {"1 D": 1, "1 W": 7, "2 W": 14, "1 M": 30, "3 M": 90, "6 M": 180, "1 Y": 365, "2 Y": 730, "5 Y": 1825, "10 Y": 3650}
BAR_SECONDS = {"1 min": 60, "5 mins": 300, "15 mins": 900, "30 mins": 1800, "1 hour": 3600, "1 day": 86_400, "1 week": 604_800, "1 month": 2_592_000}
DAILY_CODES = {"1 day": "d", "1 week": "w", "1 month": "m"}
INTRADAY_CODES = {"1 min": "1m", "5 mins": "5m", "1 hour": "1h"}
SERIES = {"1 day": "TIME_SERIES_DAILY_ADJUSTED", "1 week": "TIME_SERIES_WEEKLY_ADJUSTED", "1 month": "TIME_SERIES_MONTHLY_ADJUSTED"}
INTRADAY_SERIES = {"1 min": "1min", "5 mins": "5min", "15 mins": "15min", "30 mins": "30min", "1 hour": "60min"}
EASTERN = "US/Eastern"


def to_unix(day: str) -> int:
    """Unix seconds of midnight in New York."""
    return int(datetime.fromisoformat(day).replace(tzinfo=ZoneInfo(EASTERN)).timestamp())


class Source(ABC):
    """A source of bars; ``fetch`` returns (symbol, ts, open, high, low, close, volume)."""

    def __init__(self, spark: SparkSession, **config: object):
        self.spark, self.config = spark, config

    @abstractmethod
    def fetch(self, ticker: str, **options: object) -> DataFrame: ...


_sources: dict[str, type[Source]] = {}


def register_source(name: str) -> Callable[[type[Source]], type[Source]]:
    def add(cls: type[Source]) -> type[Source]:
        _sources[name] = cls
        return cls

    return add


def get_source(name: str) -> type[Source]:
    if name not in _sources:
        raise ValueError(f"unknown source {name!r}; there are {', '.join(list_sources())}")
    return _sources[name]


def list_sources() -> list[str]:
    return sorted(_sources)


def registered_sources() -> dict[str, type[Source]]:
    return dict(_sources)


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")


def _ordered(rows: DataFrame, ticker: str) -> DataFrame:
    return rows.select(F.lit(ticker).alias("symbol"), "ts", *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")])


@register_source("synthetic")
class Synthetic(Source):
    def fetch(self, ticker: str = "SYN", **options: object) -> DataFrame:
        return synthetic_bars(self.spark, ticker, **options)


@register_source("parquet")
class LocalParquet(Source):
    """Files <path>/<security type>/<bar size>/<ticker>.parquet with a column datetime. A window only applies with an end date."""

    def fetch(self, ticker: str = "MSFT", security_type: str = "STK", bar_size: str = "1 day", duration: str = "1 Y", end_date: str | None = None) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.config['path']}/{security_type}/{bar_size.replace(' ', '_')}/{ticker}.parquet")
        if end_date is not None:
            end = F.lit(end_date).cast("timestamp_ntz")
            rows = rows.where((F.col("datetime") > F.date_sub(end, DURATION_DAYS[duration]).cast("timestamp_ntz")) & (F.col("datetime") <= end))
        named = rows.select(*[F.col(c).alias(c.lower()) for c in rows.columns])
        return _ordered(named.withColumn("ts", F.col("datetime").cast("timestamp_ntz")), ticker)


class HttpSource(Source):
    """A service that answers with JSON. ``read`` (a function of the URL) can be given for tests; errors give no rows."""

    def _read(self, url: str) -> str | None:
        read = self.config.get("read")
        try:
            if read:
                return read(url)
            with urlopen(url, timeout=30) as answer:  # noqa: S310
                return answer.read().decode()
        except OSError:
            return None


@register_source("eodhd")
class EndOfDay(HttpSource):
    """End-of-day bars, or bars of minutes and hours in New York's time."""

    def fetch(self, ticker: str = "SPY", bar_size: str = "1 day", duration: str = "1 Y", end_date: str | None = None, security_type: str = "STK") -> DataFrame:
        name = ticker if "." in ticker or security_type != "STK" else f"{ticker}.US"
        end = datetime.fromisoformat(end_date) if end_date else datetime.now()
        begin = end - timedelta(days=DURATION_DAYS[duration])
        key = {"api_token": self.config.get("key") or os.environ.get("EODHD_API_KEY", ""), "fmt": "json"}
        if bar_size in DAILY_CODES:
            url = f"https://eodhd.com/api/eod/{name}?" + urlencode(key | {"period": DAILY_CODES[bar_size], "from": f"{begin:%Y-%m-%d}", "to": f"{end:%Y-%m-%d}"})
            kind, ts = "date string", F.col("date").cast("timestamp_ntz")
        elif bar_size in INTRADAY_CODES:
            url = f"https://eodhd.com/api/intraday/{name}?" + urlencode(key | {"interval": INTRADAY_CODES[bar_size], "from": to_unix(f"{begin:%Y-%m-%d}"), "to": to_unix(f"{end:%Y-%m-%d}")})
            kind, ts = "timestamp long", F.from_utc_timestamp(F.timestamp_seconds("timestamp"), EASTERN).cast("timestamp_ntz")
        else:
            raise ValueError(f"unknown bar size {bar_size!r}")
        answer = self._read(url)
        if not answer:
            return _empty(self.spark)
        rows = self.spark.createDataFrame([(answer,)], "body string").select(F.explode(F.from_json("body", f"array<struct<{', '.join(x.replace(' ', ': ') for x in [kind, 'open double', 'high double', 'low double', 'close double', 'volume double'])}>>")).alias("r")).select("r.*")
        return _ordered(rows.withColumn("ts", ts), ticker)


@register_source("alphavantage")
class TimeSeries(HttpSource):
    """Adjusted daily, weekly and monthly bars, or bars of minutes. The answer nests bars under their time; it is flattened by Spark."""

    def fetch(self, ticker: str = "SPY", bar_size: str = "1 day", month: str | None = None) -> DataFrame:
        query = {"symbol": ticker, "outputsize": "full", "apikey": self.config.get("key") or os.environ.get("ALPHAVANTAGE_API_KEY", "")}
        if bar_size in INTRADAY_SERIES:
            query |= {"function": "TIME_SERIES_INTRADAY", "interval": INTRADAY_SERIES[bar_size]} | ({"month": month} if month else {})
        elif bar_size in SERIES:
            query["function"] = SERIES[bar_size]
        else:
            raise ValueError(f"unknown bar size {bar_size!r}")
        answer = self._read("https://www.alphavantage.co/query?" + urlencode(query))
        if not answer:
            return _empty(self.spark)
        try:
            series = next((v for k, v in json.loads(answer).items() if "Time Series" in k), None)
        except ValueError:
            series = None
        if not series:
            return _empty(self.spark)
        body = self.spark.createDataFrame([(json.dumps(series),)], "body string")
        rows = body.select(F.explode(F.from_json("body", "map<string,map<string,string>>")).alias("at", "bar"))
        # keys are numbered, such as "4. close"; adjusted series have their own volume number
        plain = rows.select("at", F.transform_keys("bar", lambda k, _: F.regexp_replace(k, r"^\d+\. ", "")).alias("bar"))
        return _ordered(plain.select(F.col("at").cast("timestamp_ntz").alias("ts"), *[F.col("bar")[c].alias(c) for c in ("open", "high", "low", "close", "volume")]), ticker).orderBy("ts")


@register_source("yahoo")
class History(HttpSource):
    """Adjusted daily history from the chart service."""

    def fetch(self, ticker: str = "SPY", range_: str = "1y", interval: str = "1d") -> DataFrame:
        answer = self._read(f"https://query1.finance.yahoo.com/v8/finance/chart/{ticker}?" + urlencode({"range": range_, "interval": interval}))
        if not answer:
            return _empty(self.spark)
        values = "array<double>"
        kind = f"chart struct<result: array<struct<timestamp: array<long>, indicators: struct<quote: array<struct<open: {values}, high: {values}, low: {values}, close: {values}, volume: {values}>>, adjclose: array<struct<adjclose: {values}>>>>>>"
        one = self.spark.createDataFrame([(answer,)], "body string").select(F.from_json("body", kind).alias("j")).select(F.get("j.chart.result", F.lit(0)).alias("r"))
        q, adj = F.get("r.indicators.quote", F.lit(0)), F.get("r.indicators.adjclose", F.lit(0))["adjclose"]
        rows = one.select(F.explode(F.arrays_zip(F.col("r.timestamp").alias("at"), *[q[c].alias(c) for c in ("open", "high", "low", "close", "volume")], F.coalesce(adj, q["close"]).alias("adj"))).alias("z")).select("z.*")
        factor = F.coalesce(F.try_divide(F.col("adj"), F.col("close")), F.lit(1.0))
        made = rows.select(F.timestamp_seconds("at").cast("timestamp_ntz").alias("ts"), *[(F.col(c) * factor).alias(c) for c in ("open", "high", "low", "close")], "volume")
        return _ordered(made.where("close is not null"), ticker)


@register_source("tws")
class Workstation(Source):
    """Bars of a broker's workstation, through a client object that the caller connects (``client``): it returns rows (time, open, high, low, close, volume)."""

    def fetch(self, ticker: str = "SPY", security_type: str = "STK", bar_size: str = "1 day", duration: str = "1 Y", end_date: str | None = None) -> DataFrame:
        client = self.config.get("client")
        if client is None:
            raise ValueError("the workstation source needs a connected client")
        end = None
        for form in ("%Y-%m-%d", "%Y%m%d %H:%M:%S"):
            try:
                end = datetime.strptime(end_date, form) if end_date else None
                break
            except ValueError:
                continue
        kind = {"STK": "stock", "IDX": "index", "FX": "forex"}.get(security_type, "contract")
        try:
            rows = client(ticker=ticker, kind=kind, bar_size=bar_size, duration=duration, end=end)
        except OSError:
            return _empty(self.spark)
        made = self.spark.createDataFrame([(str(r[0]), *map(float, r[1:])) for r in rows], "ts string, open double, high double, low double, close double, volume double")
        return _ordered(made.withColumn("ts", F.col("ts").cast("timestamp_ntz")), ticker)


class Gatherer:
    """All registered sources behind one call. The ticker "random" stands for one of ``symbols``."""

    def __init__(self, spark: SparkSession, symbols: DataFrame | None = None, **config: dict):
        self.spark, self.symbols = spark, symbols
        self.sources = {name: cls(spark, **config.get(name, {})) for name, cls in registered_sources().items()}

    def random_tickers(self, n: int = 30, seed: int = 0) -> list[str]:
        """At most ``n`` different symbols, the first by a hash with the seed."""
        if self.symbols is None:
            raise ValueError("no table of symbols")
        name = self.symbols.columns[0]
        return [r[0] for r in self.symbols.select(name).distinct().orderBy(F.xxhash64(F.col(name), F.lit(seed)), name).limit(n).collect()]

    def get(self, ticker: str, source: str = "eodhd", **options: object) -> DataFrame:
        if source not in self.sources:
            raise ValueError(f"unknown source {source!r}; there are {', '.join(sorted(self.sources))}")
        name = self.random_tickers(1)[0] if ticker.lower() == "random" else ticker
        return self.sources[source].fetch(name, **options)
