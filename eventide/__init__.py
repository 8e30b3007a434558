"""eventide: event-study analytics for market prices, written as Spark jobs."""

__version__ = "0.1.0"
