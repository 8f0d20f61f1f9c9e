"""matchrank: search-relevance data processing as composable Spark DataFrame functions."""
