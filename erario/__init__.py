"""Budget analytics as Spark jobs: cleaning, star warehouse, OLAP queries, models."""
