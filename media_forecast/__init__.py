"""Ad-spend analytics and revenue forecasting as Spark DataFrame operators."""

__version__ = "0.1.0"
