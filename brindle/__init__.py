"""brindle: a Spark-native engine for web-content quality and search / AI-answer visibility analytics."""

__version__ = "0.1.0"
