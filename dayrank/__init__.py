"""Next-day purchase features and ranking over a user-behaviour log, as Spark DataFrame jobs."""

from dayrank.config import FeatureConfig

__all__ = ["FeatureConfig"]
