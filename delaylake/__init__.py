"""Analytics over append-only prediction archives, on Spark."""
