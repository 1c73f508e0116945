"""Operators that a large training-data pipeline needs, over document, embedding and label tables."""
