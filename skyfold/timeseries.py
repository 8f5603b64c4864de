"""Quantities along time: DataFrames of a scale factor ``a`` and a value (a number or an array)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .units import COSMIC, CodeUnits, Unit

REDUCERS = {"mean": F.avg, "sum": F.sum, "std": F.stddev_pop, "var": F.var_pop, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class TimeSeries:
    """``df`` has the columns a (or time, for a run that is not comoving) and value."""

    df: DataFrame
    unit: Unit
    h: float = 1.0
    comoving: bool = True

    @staticmethod
    def of(df: DataFrame, unit: str, h: float = 1.0, comoving: bool = True, code: CodeUnits | None = None) -> TimeSeries:
        return TimeSeries(df, Unit.parse(unit, code), h, comoving)

    @property
    def axis(self) -> str:
        return "a" if self.comoving else "time"

    def _array(self) -> bool:
        return self.df.schema["value"].dataType.typeName() == "array"

    def _times(self, factor: Column) -> Column:
        return F.transform("value", lambda x: x * factor) if self._array() else F.col("value") * factor

    def to_physical(self) -> TimeSeries:
        """a and h multiplied in, each row at its own a."""
        factor = F.lit(self.h ** float(self.unit.power("h")))
        if self.comoving and self.unit.power("a"):
            factor = factor * F.pow(F.col("a"), F.lit(float(self.unit.power("a"))))
        return TimeSeries(self.df.withColumn("value", self._times(factor)), self.unit.without(*COSMIC), self.h, self.comoving)

    def to_comoving(self, unit: Unit) -> TimeSeries:
        if unit.physical().powers != self.unit.physical().powers:
            raise ValueError("only powers of a and h may change")
        factor = F.lit(self.unit.scale / unit.scale * self.h ** float(self.unit.power("h") - unit.power("h"))) * F.pow(F.col("a"), F.lit(float(self.unit.power("a") - unit.power("a"))))
        return TimeSeries(self.df.withColumn("value", self._times(factor)), unit, self.h, self.comoving)

    def to(self, unit: Unit) -> TimeSeries:
        new = Unit(unit.scale, unit.powers | self.unit.cosmic().powers) if not unit.cosmic().powers else unit
        return TimeSeries(self.df.withColumn("value", self._times(F.lit(self.unit.factor_to(new)))), new, self.h, self.comoving)

    def no_small_h(self) -> TimeSeries:
        return TimeSeries(self.df.withColumn("value", self._times(F.lit(self.h ** float(self.unit.power("h"))))), self.unit.without("h"), self.h, self.comoving)

    def reduce_time(self, how: str) -> DataFrame:
        """One value over all times; not a time series any more."""
        return self.df.agg(REDUCERS[how]("value").alias("value"))

    def reduce_rows(self, how: str) -> TimeSeries:
        """One value for each time, over the array."""
        if not self._array():
            raise ValueError("the values are single numbers")
        n = F.size("value")
        total = F.aggregate("value", F.lit(0.0), lambda s, x: s + x)
        mean = total / n
        spread = F.aggregate(F.transform("value", lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda s, x: s + x) / n
        out = {"sum": total, "mean": mean, "var": spread, "std": F.sqrt(spread), "min": F.array_min("value"), "max": F.array_max("value")}[how]
        return TimeSeries(self.df.withColumn("value", out), self.unit, self.h, self.comoving)

    def between(self, low: float, high: float) -> TimeSeries:
        """Times low <= a < high."""
        return TimeSeries(self.df.filter((F.col(self.axis) >= low) & (F.col(self.axis) < high)), self.unit, self.h, self.comoving)

    def at(self, a: float) -> DataFrame:
        return self.df.filter(F.col(self.axis) == a).select("value")

    def concat(self, other: TimeSeries) -> TimeSeries:
        """Rows of both, along time."""
        self._check(other)
        return TimeSeries(self.df.unionByName(other.df), self.unit, self.h, self.comoving)

    def stack(self, other: TimeSeries) -> TimeSeries:
        """Arrays of both values at the same times; raises where the times differ."""
        self._check(other)
        pair = self.df.select(self.axis, F.col("value").alias("__l")).join(other.df.select(self.axis, F.col("value").alias("__r")), self.axis, "full")
        if pair.filter("__l IS NULL OR __r IS NULL").limit(1).count():
            raise ValueError("the series have different times")
        return TimeSeries(pair.select(self.axis, F.array("__l", "__r").alias("value")), self.unit, self.h, self.comoving)

    def _check(self, other: TimeSeries) -> None:
        if self.unit != other.unit or self.h != other.h or self.comoving != other.comoving:
            raise ValueError("units or h differ")
