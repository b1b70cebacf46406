"""Channel predicates with IEEE comparison of NaN.

Spark holds NaN equal to itself and larger than all numbers; here a comparison
with NaN is false, and ``!=`` and ``not in`` are true.  Null fails every test.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


@dataclass(frozen=True)
class Predicate:
    channel: str
    op: str
    value: float | tuple[float, ...]

    def column(self, floating: bool = True) -> Column:
        c = F.col(f"`{self.channel}`")
        if self.op in _COMPARE:
            if isinstance(self.value, float) and math.isnan(self.value):
                return c.isNotNull() if self.op == "!=" else F.lit(False)
            plain = _COMPARE[self.op](c, F.lit(self.value))
            # to Spark, too, NaN differs from every number and lies under none
            return plain & ~F.isnan(c) if floating and self.op in (">", ">=") else plain
        values = [v for v in self.value if not (isinstance(v, float) and math.isnan(v))]
        inside = c.isin(*values) if values else F.lit(False)
        if self.op == "in":
            return inside
        return c.isNotNull() & ~inside


@dataclass(frozen=True)
class FilterSpec:
    """Predicates that all must hold; none lets everything pass.  The add methods return a longer spec."""

    predicates: tuple[Predicate, ...] = field(default=())

    def add(self, channel: str, op: str, value: float) -> FilterSpec:
        if op not in _COMPARE:
            raise ValueError(f"unknown comparison {op!r}")
        return FilterSpec((*self.predicates, Predicate(channel, op, value)))

    def add_in_set(self, channel: str, values: Iterable[float]) -> FilterSpec:
        return FilterSpec((*self.predicates, Predicate(channel, "in", tuple(values))))

    def add_not_in_set(self, channel: str, values: Iterable[float]) -> FilterSpec:
        return FilterSpec((*self.predicates, Predicate(channel, "not in", tuple(values))))

    def check(self, df: DataFrame) -> None:
        for p in self.predicates:
            if p.channel not in df.columns:
                raise ValueError(f"filter channel {p.channel!r} does not exist")
            if not isinstance(df.schema[p.channel].dataType, NumericType):
                raise ValueError(f"filter channel {p.channel!r} is not numeric")

    def column(self, df: DataFrame) -> Column | None:
        self.check(df)
        floating = lambda name: isinstance(df.schema[name].dataType, FloatType | DoubleType)
        parts = [p.column(floating(p.channel)) for p in self.predicates]
        return reduce(operator.and_, parts) if parts else None

    def apply(self, df: DataFrame) -> DataFrame:
        c = self.column(df)
        return df if c is None else df.where(c)

    def selected(self, df: DataFrame, name: str = "index") -> DataFrame:
        """The row numbers that pass, as one column; numbers grow with the order of partitions and rows."""
        return self.apply(df.withColumn(name, F.monotonically_increasing_id())).select(name)
