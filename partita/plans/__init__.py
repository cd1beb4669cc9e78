"""Plans of the partition engine."""
