"""Network-flow detection analytics as Spark jobs."""
