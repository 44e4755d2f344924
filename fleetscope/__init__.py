"""Host-telemetry analytics across a fleet, on Spark."""
