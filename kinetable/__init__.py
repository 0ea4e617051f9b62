"""Pose and event-stream analytics expressed as Spark DataFrame jobs."""
