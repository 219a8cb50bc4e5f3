"""Functions of the array engine."""
