"""meterlake: usage telemetry of coding assistants as Spark DataFrame operators."""
