"""castleflow: a Spark-native engine for archives of public chess games."""

__version__ = "0.1.0"
