"""Operators for training-data pipelines; see ``queries`` for what is registered."""
