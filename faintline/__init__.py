"""faintline: weak-signal and trend analytics expressed as Spark DataFrame operations."""
