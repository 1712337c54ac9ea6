"""Analytics on documents that are published and then revised, as Spark DataFrame operators."""

from verstext.config import MatchConfig

__all__ = ["MatchConfig"]
