"""trailmart: Spark-native analytics for shopping catalogues and agent trajectories."""
