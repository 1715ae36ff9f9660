"""Oracle functions as Spark SQL."""
