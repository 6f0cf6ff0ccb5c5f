"""zonalyx: a Spark-native engine for area indices, event panels and graph features."""

__version__ = "0.1.0"
