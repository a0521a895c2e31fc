"""Operators for large-scale training-data pipelines (see ``queries.py``)."""
