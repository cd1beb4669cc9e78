"""partita: leakage-safe dataset partitioning and corpus preparation on PySpark."""

__version__ = "0.1.0"
