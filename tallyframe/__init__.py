"""Spark-native market analytics: composable DataFrame operators and their query catalogue."""

__version__ = "0.1.0"
