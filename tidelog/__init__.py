"""Tidelog: a Spark-native engine for logs, events and machine telemetry."""
