"""storyloom: a Spark-native engine for structured, evidence-backed fiction data."""

__version__ = "0.1.0"
