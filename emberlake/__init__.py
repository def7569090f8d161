"""emberlake: hazard-event analytics as Spark DataFrame operators."""
