"""Spark-native analytics over annual time series, class maps and training corpora."""
