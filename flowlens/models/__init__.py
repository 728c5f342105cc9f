"""Model training, scoring and attribution as Spark jobs."""
