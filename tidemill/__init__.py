"""Table profiling, cleaning and ML preparation as Spark jobs."""
