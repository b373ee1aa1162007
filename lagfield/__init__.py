"""Event-locked encoding jobs on Spark."""
