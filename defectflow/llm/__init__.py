"""Operators of a training-data pipeline over the tables ``documents``, ``pages`` and ``benchmark``."""
