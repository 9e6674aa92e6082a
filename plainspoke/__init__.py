"""Communication audit, log analytics and text cleaning as Spark jobs."""
