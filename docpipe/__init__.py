"""A Spark-native engine for semi-structured documents."""

from .session import Collection, Cursor, Database, Engine

__all__ = ["Collection", "Cursor", "Database", "Engine"]
