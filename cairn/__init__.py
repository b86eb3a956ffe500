"""Point-cloud analytics expressed as Spark DataFrame transformations."""
