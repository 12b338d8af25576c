"""One object that owns a frame of bars and adds to it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tickweave.operators import indicators as I
from tickweave.operators import labels as L
from tickweave.operators import stats


class Study:
    """A frame of bars, to which indicators, labels and weights are added. Each call replaces the lazy frame; nothing runs before an action."""

    def __init__(self, bars: DataFrame):
        self.df = bars

    @property
    def df(self) -> DataFrame:
        return self._df

    @df.setter
    def df(self, value: DataFrame) -> None:
        if not isinstance(value, DataFrame):
            raise TypeError("bars must be a DataFrame")
        self._df = value

    @df.deleter
    def df(self) -> None:
        self._df = self._df.limit(0)

    def add_indicator(self, kind: I.IndicatorType | str, column: str, **parameters) -> DataFrame:
        I.get_indicator(kind)
        if self._df.isEmpty():
            raise ValueError("there are no bars")
        self._df = I.add_indicator(self._df, kind, column, **parameters)
        return self._df

    def add_event_flags(self, method: str, **options) -> DataFrame:
        self._df = L.event_sampling(self._df, method, **options)
        return self._df

    def add_labels(self, method: str = "triple_barrier", **options) -> DataFrame:
        self._df = L.add_labels(self._df, method, **options)
        return self._df

    def add_sample_weights(self) -> DataFrame:
        self._df = L.add_sample_weights(self._df)
        return self._df

    def report(self, column: str) -> DataFrame:
        return stats.evaluation_report(self._df, column)

    @staticmethod
    def list_indicators(verbose: bool = False) -> list[str] | dict[str, str]:
        return I.list_indicators(verbose)

    @staticmethod
    def indicator_details(kind: I.IndicatorType | str) -> dict[str, object]:
        return I.indicator_parameters(kind)
