"""Versioned key-value and small relational analytics expressed as Spark DataFrame plans."""
