"""Multi-site tables with missing data, analysed as Spark DataFrame jobs."""

__version__ = "0.1.0"
