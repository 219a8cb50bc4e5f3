"""Operators of the array engine."""
