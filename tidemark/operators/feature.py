"""The user-defined feature: a class that returns a Column over a context's deferred requests."""

from __future__ import annotations

from abc import ABC, abstractmethod
from typing import TYPE_CHECKING

from pyspark.sql import Column

if TYPE_CHECKING:
    from tidemark.operators.context import FeatureContext


class Feature(ABC):
    name: str
    lookback_us: int = 0
    inputs: tuple[str, ...] = ()

    @abstractmethod
    def calculate(self, ctx: FeatureContext) -> Column:
        """The feature as a Column over what the context's methods return and the queries' own columns."""
