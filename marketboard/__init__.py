"""Market price features, forecasts, text retrieval and sell/hold verdicts as Spark jobs."""
