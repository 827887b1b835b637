"""factloom: a Spark-native engine for source-backed, time-aware knowledge data."""

__version__ = "0.1.0"
