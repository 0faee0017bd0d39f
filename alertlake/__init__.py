"""alertlake: security-alert analytics as Spark DataFrame jobs."""
