"""Spark-first analytics over irregular time series and the daily figures derived from them."""
