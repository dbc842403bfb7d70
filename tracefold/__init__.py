"""Scheduler-trace analytics on Spark."""
