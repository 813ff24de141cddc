"""Versioned, deduplicated and validated tables on Apache Spark."""
