"""granary: a PySpark-native corpus ingestion, retrieval and analytics library."""

from granary.session import build_session

__all__ = ["build_session"]
