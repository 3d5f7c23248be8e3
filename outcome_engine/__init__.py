"""Marketing-outcome analytics on Spark: events -> mergeable aggregates -> scores."""
