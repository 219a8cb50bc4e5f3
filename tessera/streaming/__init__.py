"""Streaming of the array engine."""
