"""Contract-policy analytics expressed as Spark DataFrame plans."""
