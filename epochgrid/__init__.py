"""A Spark-native engine for historical places and the entities that occupied them."""

__version__ = "0.1.0"
