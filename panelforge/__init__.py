"""Panel analytics on Spark: event tables to feature panels, models and projections."""
