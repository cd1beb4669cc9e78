"""Sources of the partition engine."""
