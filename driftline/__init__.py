"""Time-series statistics as Spark DataFrame operators."""
