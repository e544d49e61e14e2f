"""Streaming market, order and change-log analytics as plain Spark DataFrame functions."""
