"""Time-series rule mining on Spark."""
