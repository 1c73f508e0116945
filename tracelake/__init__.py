"""Observability telemetry jobs on Spark."""
