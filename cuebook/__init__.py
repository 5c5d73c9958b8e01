"""Transcript and task-log analytics as composable Spark DataFrame operators."""
