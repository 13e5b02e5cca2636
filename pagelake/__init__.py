"""pagelake: Spark-native analytics over collections of fetched web pages."""

__version__ = "0.1.0"
