"""Agent-telemetry detection and training-data preparation as Spark jobs."""
