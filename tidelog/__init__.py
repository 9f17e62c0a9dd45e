"""Analytics over log-structured, replicated key-value data, on Spark."""
