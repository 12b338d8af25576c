"""A store of daily prices (one Parquet file a ticker, or a table partitioned by ticker) with a table of company data."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OHLCV = ["open", "high", "low", "close", "volume"]


def _listed(x: str | Iterable[str] | None) -> list[str] | None:
    return None if x is None else [x] if isinstance(x, str) else list(x)


def scan_prices(prices: DataFrame, tickers: str | Iterable[str] | None = None, start: date | str | None = None, end: date | str | None = None, columns: Iterable[str] | None = None, frequency: str = "1d") -> DataFrame:
    """Rows of the tickers between both dates, bounds included. Filters and columns reach the Parquet scan.

    Unknown tickers give no rows. The result has ticker and date, without ticker for a single one.
    """
    if frequency != "1d":
        raise NotImplementedError(f"frequency {frequency!r}")
    names = _listed(tickers)
    out = prices
    if names is not None:
        out = out.where(F.col("ticker").isin(names))
    if start is not None:
        out = out.where(F.col("date") >= F.to_date(F.lit(str(start))))
    if end is not None:
        out = out.where(F.col("date") <= F.to_date(F.lit(str(end))))
    keys = ["date"] if names is not None and len(names) == 1 else ["ticker", "date"]
    return out.select(*keys, *(list(columns) if columns else [c for c in OHLCV if c in out.columns]))


def latest_prices(prices: DataFrame, tickers: Iterable[str] | None = None, columns: Iterable[str] = ("close", "volume")) -> DataFrame:
    """The row of each ticker's last date, by one mergeable aggregate."""
    rows = prices if tickers is None else prices.where(F.col("ticker").isin(_listed(tickers)))
    last = rows.groupBy("ticker").agg(F.max_by(F.struct("date", *columns), "date").alias("_last"))
    return last.select("ticker", "_last.*")


def date_range(prices: DataFrame, ticker: str) -> DataFrame:
    found = prices.where(F.col("ticker") == ticker).agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    if found.first()["first_date"] is None:
        raise ValueError(f"no prices of {ticker!r}")
    return found


def list_tickers(prices: DataFrame) -> DataFrame:
    return prices.select("ticker").distinct().orderBy("ticker")


def filter_metadata(meta: DataFrame, tickers: Iterable[str] | None = None, filters: dict[str, object] | None = None, key: str = "symbol") -> DataFrame:
    """Rows that meet all filters; a list means any of its values, compared as text."""
    out = meta if tickers is None else meta.where(F.col(key).isin(_listed(tickers)))
    for name, value in (filters or {}).items():
        out = out.where(F.col(name).cast("string").isin([str(v) for v in value]) if isinstance(value, (list, tuple, set)) else F.col(name) == F.lit(value))
    return out


def distinct_values(meta: DataFrame, column: str) -> DataFrame:
    """Values of a column that are known, in order."""
    return meta.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def sample_symbols(meta: DataFrame, n: int = 10, sector: str | None = None, min_market_cap: float | None = None, max_market_cap: float | None = None, min_volume: float | None = None, analyst_rating: str | None = None, seed: int | None = None, key: str = "symbol") -> DataFrame:
    """``n`` symbols that meet the criteria, the first by a hash of symbol and seed: the same on any cluster. Bounds of 0 count as none."""
    out = meta
    if sector:
        out = out.where(F.col("sector") == sector)
    if min_market_cap:
        out = out.where(F.col("market_cap") >= min_market_cap)
    if max_market_cap:
        out = out.where(F.col("market_cap") <= max_market_cap)
    if min_volume:
        out = out.where(F.col("volume") >= min_volume)
    if analyst_rating:
        out = out.where(F.col("analyst_rating") == analyst_rating)
    order = F.xxhash64(F.col(key), F.lit(seed or 0))
    return out.select(key).where(F.col(key).isNotNull()).distinct().orderBy(order, key).limit(n)


class PriceStore:
    """Access to a store under ``path``: prices/equities/1d/<ticker>.parquet and metadata/equities.csv.

    Every path is read by Spark, so a store can be in any file system that the cluster reads.
    """

    def __init__(self, spark: SparkSession, path: str, asset: str = "equities"):
        self.spark, self.path, self.asset = spark, path.rstrip("/"), asset
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        if not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
            raise ValueError(f"no store at {path}")
        self._views: list[str] = []
        self._tickers: list[str] | None = None

    def prices(self) -> DataFrame:
        """All files, their columns united by name, with the ticker from the file name."""
        rows = self.spark.read.option("mergeSchema", True).parquet(f"{self.path}/prices/{self.asset}/1d/*.parquet")
        named = rows.select(*[F.col(c).alias(c.lower()) for c in rows.columns], F.col("_metadata.file_path").alias("filename"))
        return named.withColumn("ticker", F.url_decode(F.regexp_extract("filename", r"([^/]+)\.parquet$", 1)))

    def metadata(self) -> DataFrame:
        return self.spark.read.csv(f"{self.path}/metadata/{self.asset}.csv", header=True, inferSchema=True)

    def register(self) -> None:
        """Temporary views "prices" and "metadata", so far as the store has them."""
        for name, make in (("prices", self.prices), ("metadata", self.metadata)):
            try:
                make().createOrReplaceTempView(name)
                self._views.append(name)
            except AnalysisException:
                continue

    def get_price_data(self, ticker: str | Iterable[str], start: str | None = None, end: str | None = None, columns: Iterable[str] | None = None, frequency: str = "1d") -> DataFrame:
        return scan_prices(self.prices(), ticker, start, end, columns, frequency)

    def get_latest_prices(self, tickers: Iterable[str] | None = None, columns: Iterable[str] = ("close", "volume")) -> DataFrame:
        return latest_prices(self.prices(), tickers, columns)

    def get_date_range(self, ticker: str) -> DataFrame:
        return date_range(self.prices(), ticker)

    def list_available_tickers(self) -> list[str]:
        if self._tickers is None:
            self._tickers = [r[0] for r in list_tickers(self.prices()).collect()]
        return self._tickers

    def close(self) -> None:
        """Drop the views. The session is the caller's."""
        for name in self._views:
            self.spark.catalog.dropTempView(name)
        self._views.clear()

    def __enter__(self) -> PriceStore:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
