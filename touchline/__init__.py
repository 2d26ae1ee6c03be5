"""touchline: Spark-native analytics for entity-versus-entity event data."""

__version__ = "0.1.0"
