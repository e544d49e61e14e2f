"""Sinks: tables, message bus, fan-out and callbacks."""
