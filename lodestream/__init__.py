"""Event-log analytics expressed as Spark DataFrame plans."""
