"""Sensor-hierarchy analytics as PySpark DataFrame and Structured Streaming operators."""
