"""Pool search and active learning as Spark jobs."""
