"""Composed telemetry queries and the registry of everything that can be run."""
