"""corpusloom: Spark-native corpus building, refresh and retrieval for web documentation."""

__all__ = ["__version__"]
__version__ = "0.1.0"
