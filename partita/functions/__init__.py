"""Functions of the partition engine."""
