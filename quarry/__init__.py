"""Quarry: a Spark-native engine for exploring, profiling and charting one table at a time."""
