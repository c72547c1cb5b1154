"""Balloon-telemetry analytics as Spark DataFrame jobs."""
