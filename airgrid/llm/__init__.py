"""Operators of a training-data pipeline over documents, vectors and pages; nothing else in the package imports them."""
