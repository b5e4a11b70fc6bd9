"""Spark-native question-bank engine: chunking, retrieval, prompting, validation, grounding, assembly."""

__version__ = "0.1.0"
