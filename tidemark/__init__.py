"""Market-signal and data-preparation jobs written as Spark DataFrame operations."""
