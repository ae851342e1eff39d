"""tidewater: market-panel analytics and time-series data processing on Spark DataFrames."""

__version__ = "0.1.0"
