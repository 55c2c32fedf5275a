"""Spark-first analytics for LLM-service telemetry, chat records and training-data preparation."""
