"""Training-data operators: ten corpus operators that run on Spark."""
