"""Event, entity and change-data analytics as Spark DataFrame transformations."""
