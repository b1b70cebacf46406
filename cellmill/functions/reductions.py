"""Reductions of the points of a cell, as partial states that merge.

A reduction is three lists of column expressions: partial states over points,
the same states over states, and the final value of a state.  Spark's partial
and final aggregation run the first; merging runs the second over stored states.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MERGEABLE = ("sum", "max", "min", "count", "average", "weighted_average", "most_recent", "priority_merge")
HOLISTIC = ("median", "percentile")
#: Reductions that a footprint of weighted cells may feed.
WEIGHTED = ("sum", "count", "average", "weighted_average")


@dataclass(frozen=True)
class CustomReduction:
    """A user's reduction.

    partial: value column -> list of aggregate columns, one per state.
    merge: state columns -> list of aggregate columns over states; None if states cannot merge.
    finalize: state columns -> the value.
    """

    partial: Callable[[Column], list[Column]]
    finalize: Callable[..., Column] = lambda *s: s[0]
    merge: Callable[..., list[Column]] | None = None


@dataclass(frozen=True)
class Reduction:
    """What becomes of the values in a cell.

    value: channel, of any numeric type; null values contribute nothing.
    weight: channel of weighted_average, 1 without it.
    order: time channel of most_recent, priority channel of priority_merge; the largest wins.
    ties: channels that decide between equal times or priorities, smallest first; the larger value at last.
    percentile: 0 to 1; interpolates between neighbours.
    band: name of the result; by default channel_kind.
    glyph: spreads points over cells (see cellmill.operators.glyphs).
    """

    value: str
    kind: str = "average"
    weight: str | None = None
    order: str | None = None
    ties: tuple[str, ...] = ()
    percentile: float = 0.5
    band: str | None = None
    glyph: object | None = None
    custom: CustomReduction | None = None

    @property
    def name(self) -> str:
        return self.band or f"{self.value}_{self.kind}"

    @property
    def states(self) -> int:
        if self.kind in ("average", "weighted_average"):
            return 2
        return len(self.custom.partial(F.lit(0.0))) if self.custom else 1

    @property
    def mergeable(self) -> bool:
        return self.kind in MERGEABLE or bool(self.custom and self.custom.merge)

    def channels(self) -> list[str]:
        return [c for c in (self.value, self.weight, self.order, *self.ties) if c]

    def check(self) -> None:
        if self.custom is None and self.kind not in MERGEABLE + HOLISTIC:
            raise ValueError(f"unknown reduction {self.kind!r}")
        if self.kind in ("most_recent", "priority_merge") and not self.order:
            raise ValueError(f"{self.kind} needs an order channel")
        if not 0 <= self.percentile <= 1:
            raise ValueError("percentile lies between 0 and 1")
        if self.glyph is not None and getattr(self.glyph, "kind", "point") != "point" and (self.custom or self.kind not in WEIGHTED):
            raise NotImplementedError(f"{self.kind} cannot take weighted cells; use one of {', '.join(WEIGHTED)}")

    def partial(self, weight: Column | None = None) -> list[Column]:
        """weight: of a glyph's cell."""
        v = F.col(f"`{self.value}`").cast("double")
        if self.custom:
            return self.custom.partial(v)
        number = F.when(~F.isnan(v), v)
        if weight is not None:
            there = F.when(v.isNotNull(), weight)
            return {"sum": [F.sum(v * weight)], "count": [F.sum(there)]}.get(self.kind, [F.sum(v * weight), F.sum(there)])
        match self.kind:
            case "sum":
                return [F.sum(v)]
            case "max":
                return [F.max(number)]
            case "min":
                return [F.min(number)]
            case "count":
                return [F.count(v)]
            case "average":
                return [F.sum(v), F.count(v).cast("double")]
            case "weighted_average":
                w = F.col(f"`{self.weight}`").cast("double") if self.weight else F.lit(1.0)
                return [F.sum(v * w), F.sum(F.when(v.isNotNull(), w))]
            case "most_recent" | "priority_merge":
                rank = [F.col(f"`{self.order}`").alias("at")] + [(-F.col(f"`{c}`")).alias(f"t{i}") for i, c in enumerate(self.ties)]
                known = v.isNotNull() & F.col(f"`{self.order}`").isNotNull()
                return [F.max(F.when(known, F.struct(*rank, v.alias("v"))))]
            case "median":
                return [F.percentile(v, 0.5)]
            case "percentile":
                return [F.percentile(v, self.percentile)]
        raise ValueError(self.kind)

    def merge(self, states: list[Column]) -> list[Column]:
        if self.custom and self.custom.merge:
            return self.custom.merge(*states)
        if not self.mergeable:
            raise ValueError(f"{self.kind} has no states that merge; reduce all points at once")
        how = {"max": F.max, "most_recent": F.max, "priority_merge": F.max, "min": F.min}.get(self.kind, F.sum)
        return [how(s) for s in states]

    def finalize(self, states: list[Column]) -> Column:
        if self.custom:
            return self.custom.finalize(*states)
        if self.kind in ("average", "weighted_average"):
            return F.when(states[1] > 0, F.try_divide(states[0], states[1]))
        if self.kind in ("most_recent", "priority_merge"):
            return states[0]["v"]
        if self.kind == "count":  # a cell without counted points is empty
            return F.when(states[0] > 0, states[0])
        return states[0]
