"""Mail-archive analytics as Spark table jobs and queries."""
