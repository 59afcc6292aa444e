"""Operators for training-data pipelines; their check queries are in ``queries``."""
