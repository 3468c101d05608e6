"""tidemark: point-in-time analytics on Spark DataFrames.

Missing values are NULL inside the engine (NaN is turned into NULL at the scan),
timestamps are int64 microseconds UTC, and every row carries a unique ``row_id``.
"""

from tidemark.operators.context import FeatureContext
from tidemark.operators.feature import Feature
from tidemark.operators.feature_set import FeatureSet
from tidemark.operators.library import DEFAULT_FEATURES
from tidemark.schema import Params

__all__ = ["DEFAULT_FEATURES", "Feature", "FeatureContext", "FeatureSet", "Params"]
