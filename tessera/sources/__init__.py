"""Sources of the array engine."""
