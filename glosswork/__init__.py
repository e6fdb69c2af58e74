"""Comment analytics on Spark: text functions, relational steps, statistics and extraction as DataFrame jobs."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
