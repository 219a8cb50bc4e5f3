"""Plans of the array engine."""
