"""eventcast: event panels, features, forecasts and evaluation as Spark DataFrames."""

__version__ = "0.1.0"
