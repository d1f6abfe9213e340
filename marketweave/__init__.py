"""Spark-native market research engine: long tables in, DataFrames out."""
