"""Operators that prepare text for training: one module for each, queries in `queries`."""
