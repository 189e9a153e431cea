"""dnslens: DNS telemetry analytics as Spark DataFrame and streaming operators."""
