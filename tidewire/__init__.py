"""tidewire: a Spark-native engine for news text, entities and activity statistics."""

__all__ = ["__version__"]
__version__ = "0.1.0"
