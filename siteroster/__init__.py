"""Contact analytics over captured web pages, written as Spark jobs."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
