"""Feature registry: a name, a family, the inputs it may read and the Column that computes it."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

# Columns a feature may be computed from. Anything forward-looking is not in this list.
ALLOWED_INPUTS = frozenset(
    "open high low close pre_close pct vol amount d index_return turnover shares market_value book_ratio earnings_ratio "
    "dividend_yield up_limit down_limit status industry".split()
)


@dataclass(frozen=True)
class FeatureSpec:
    name: str
    family: str
    inputs: tuple[str, ...]
    build: Callable[[], Column] = field(compare=False)
    event_only: bool = False


class FeatureRegistry:
    def __init__(self) -> None:
        self._specs: dict[str, FeatureSpec] = {}

    def add(self, name: str, family: str, inputs: str, build: Callable[[], Column], event_only: bool = False) -> None:
        spec = FeatureSpec(name, family, tuple(inputs.split()), build, event_only)
        if name in self._specs:
            raise ValueError(f"feature {name} is already registered")
        foreign = set(spec.inputs) - ALLOWED_INPUTS
        if foreign:
            raise ValueError(f"feature {name} reads inputs outside the allowed list: {sorted(foreign)}")
        self._specs[name] = spec

    def family(self, family: str, inputs: str, columns: dict[str, Callable[[], Column]]) -> None:
        for name, build in columns.items():
            self.add(name, family, inputs, build)

    def specs(self, families: Iterable[str] | None = None) -> list[FeatureSpec]:
        wanted = None if families is None else set(families)
        return [s for s in self._specs.values() if wanted is None or s.family in wanted]

    def names(self, families: Iterable[str] | None = None) -> list[str]:
        return [s.name for s in self.specs(families)]

    def columns(self, families: Iterable[str] | None = None) -> list[Column]:
        return [s.build().alias(s.name) for s in self.specs(families)]

    def compute(self, prepared: DataFrame, keys: Iterable[str] = ("sym", "d"), families: Iterable[str] | None = None) -> DataFrame:
        """Keys and the features of the chosen families; one projection over the prepared panel."""
        return prepared.select(*keys, *self.columns(families))
