"""Composed jobs: the batch run, and the registered queries with their checks."""
