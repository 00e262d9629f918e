"""The time-bucket operators on unbounded input."""
