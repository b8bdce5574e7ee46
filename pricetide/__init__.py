"""pricetide: price-series analytics and forecast scoring as Spark jobs."""

__version__ = "0.1.0"
