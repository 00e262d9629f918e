"""Reading captures and parameter files, and writing results."""
