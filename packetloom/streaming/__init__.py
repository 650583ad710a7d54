"""The telemetry queries on packet streams, with watermarks and windows."""
