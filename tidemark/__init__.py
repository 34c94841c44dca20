"""Engineering-activity analytics as Spark jobs."""
