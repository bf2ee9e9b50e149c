"""detframe: object-detection analytics as Spark DataFrame jobs."""
