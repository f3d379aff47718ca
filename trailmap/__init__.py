"""trailmap: relational analytics over application navigation graphs, on PySpark."""
