"""Tower telemetry analytics as Spark DataFrame operators."""
