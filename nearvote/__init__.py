"""Nearest-neighbour transaction scoring and training-data operators on Spark."""
