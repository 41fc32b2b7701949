"""Event-data preparation and reconstruction evaluation as Spark DataFrame operators."""
